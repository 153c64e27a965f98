"""The typed property graph's vocabulary: node types, relations, and the triples that may join them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Names and triples that graphs exchange.
NODE_TYPES = ("Character", "Event", "Location", "TimePoint", "Object", "Vehicle", "Concept")
ENTITY_TYPES = ("Character", "Location", "TimePoint", "Object", "Vehicle", "Concept")
RELATIONS = (
    "performs", "undergoes", "experiences", "kinship_with", "affinity_with", "hostility_with", "affiliated_with",
    "precedes", "occurs_after", "causes", "contrasts_with", "references", "occurs_at", "occurs_on", "located_at",
    "present_on", "possesses", "uses", "is_a", "part_of",
)
#: The triples (source type, relation, target type) that may be.
TRIPLES = (
    ("Character", "performs", "Event"),
    ("Object", "performs", "Event"),
    ("Concept", "performs", "Event"),
    ("Vehicle", "performs", "Event"),
    ("Character", "undergoes", "Event"),
    ("Object", "undergoes", "Event"),
    ("Vehicle", "undergoes", "Event"),
    ("Character", "experiences", "Event"),
    ("Character", "kinship_with", "Character"),
    ("Character", "affinity_with", "Character"),
    ("Character", "hostility_with", "Character"),
    ("Character", "affiliated_with", "Concept"),
    ("Concept", "affiliated_with", "Concept"),
    ("Event", "precedes", "Event"),
    ("Event", "occurs_after", "Event"),
    ("Event", "causes", "Event"),
    ("Event", "contrasts_with", "Event"),
    ("Event", "references", "Event"),
    ("Event", "occurs_at", "Location"),
    ("Event", "occurs_at", "Vehicle"),
    ("Event", "occurs_on", "TimePoint"),
    ("Character", "located_at", "Location"),
    ("Character", "located_at", "Vehicle"),
    ("Object", "located_at", "Location"),
    ("Concept", "located_at", "Location"),
    ("Vehicle", "located_at", "Location"),
    ("Character", "present_on", "TimePoint"),
    ("Object", "present_on", "TimePoint"),
    ("Concept", "present_on", "TimePoint"),
    ("Vehicle", "present_on", "TimePoint"),
    ("Character", "possesses", "Object"),
    ("Character", "possesses", "Vehicle"),
    ("Concept", "possesses", "Object"),
    ("Character", "uses", "Object"),
    ("Character", "uses", "Vehicle"),
    ("Object", "uses", "Object"),
    ("Character", "is_a", "Concept"),
    ("Object", "is_a", "Concept"),
    ("Vehicle", "is_a", "Concept"),
    ("Concept", "is_a", "Concept"),
    ("Object", "part_of", "Object"),
    ("Object", "part_of", "Location"),
    ("Object", "part_of", "Vehicle"),
    ("Location", "part_of", "Location"),
    ("Vehicle", "part_of", "Vehicle"),
    ("Vehicle", "part_of", "Location"),
    ("Character", "part_of", "Concept"),
    ("Concept", "part_of", "Concept"),
)
#: Relations whose reverse edge is added, with the reverse relation.
REVERSED = {"kinship_with": "kinship_with", "affinity_with": "affinity_with", "hostility_with": "hostility_with", "precedes": "occurs_after"}
#: Relations that describe a moment, not a lasting fact.
TRANSIENT = ("occurs_at", "located_at", "performs", "participates_in", "witnesses")


def valid_triples() -> list[tuple[str, str, str]]:
    """All (source type, relation, target type) triples, sorted."""
    return sorted(TRIPLES)


def triples(spark: SparkSession) -> DataFrame:
    """The triples as a table (source_type, relation, target_type); small, so joins broadcast it."""
    return spark.createDataFrame(valid_triples(), "source_type string, relation string, target_type string")


def is_valid_triple(source_type: str, relation: str, target_type: str) -> bool:
    return (source_type, relation, target_type) in set(valid_triples())


def valid_relations(source_type: str, target_type: str) -> list[str]:
    """Relations that may join two types."""
    return sorted(r for s, r, t in valid_triples() if (s, t) == (source_type, target_type))


def triples_sql() -> str:
    """The triples as a SQL relation."""
    rows = ", ".join(f"('{s}', '{r}', '{t}')" for s, r, t in valid_triples())
    return f"(SELECT * FROM (VALUES {rows}) AS v(source_type, relation, target_type))"
