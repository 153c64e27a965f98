"""Text and corpus queries over documents, pages, parts and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from narrata.functions import text
from narrata.operators import corpus

from .registry import query, table


def _in(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _digest(array):
    return F.md5(F.array_join(F.array_sort(array), " "))


FOLD_SQL = r"regexp_replace(strip_accents(coalesce(text, '')), '[^\x00-\x7F]', '', 'g')"


@query(r"SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}_]+'))::INT AS words FROM documents")
def word_count(spark, d):
    return table(spark, d, "documents").select("doc_id", text.word_count(F.col("text")).alias("words"))


@query(f"""WITH t AS (SELECT doc_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: x NOT IN ({_in(text.DEDUPE_STOPWORDS)}))) AS k FROM documents)
SELECT doc_id, len(k)::INT AS n, md5(array_to_string(list_sort(k), ' ')) AS tokens FROM t""")
def tokens_ascii(spark, d):
    k = text.dedupe_tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(k).alias("n"), _digest(k).alias("tokens"))


SCORE_SQL = rf"""list_distinct(list_transform(list_transform(list_filter(string_split_regex(regexp_replace(lower(text), '[^a-z0-9\s]', ' ', 'g'), '\s+'),
  lambda x: x <> '' AND x NOT IN ({_in(text.SCORE_STOPWORDS)})),
  lambda x: CASE {' '.join(f"WHEN x = '{k}' THEN '{v}'" for k, v in text.NUMBER_WORDS.items())} ELSE x END),
  lambda x: CASE WHEN length(x) > 4 AND x LIKE '%ing' THEN left(x, -3) WHEN length(x) > 3 AND x LIKE '%ed' THEN left(x, -2) WHEN length(x) > 3 AND x LIKE '%s' THEN left(x, -1) ELSE x END))"""


@query(f"WITH t AS (SELECT doc_id, {SCORE_SQL} AS k FROM documents) SELECT doc_id, len(k)::INT AS n, md5(array_to_string(list_sort(k), ' ')) AS tokens FROM t")
def scorer_tokens(spark, d):
    k = text.score_tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(k).alias("n"), _digest(k).alias("tokens"))


TITLED_SQL = f"list_filter(k, lambda x: x NOT IN ({_in(text.TITLES)}))"


@query(rf"""WITH f AS (SELECT doc_id, lower(trim({FOLD_SQL})) AS t FROM documents),
g AS (SELECT doc_id, regexp_extract_all(replace(regexp_replace(t, '''s\b', '', 'g'), '''', ''), '[a-z0-9]+') AS k FROM f),
r AS (SELECT doc_id, regexp_extract_all(t, '[a-z0-9]+') AS k FROM f)
SELECT g.doc_id, md5(array_to_string(CASE WHEN len({TITLED_SQL.replace('k,', 'g.k,')}) > 0 THEN {TITLED_SQL.replace('k,', 'g.k,')} ELSE g.k END, ' ')) AS graph_name,
       md5(array_to_string(CASE WHEN len({TITLED_SQL.replace('k,', 'r.k,')}) > 0 THEN {TITLED_SQL.replace('k,', 'r.k,')} ELSE r.k END, ' ')) AS resolution_name,
       md5(trim(regexp_replace(lower(d.text), '[^a-z0-9]+', ' ', 'g'))) AS relation_name
FROM g JOIN r USING (doc_id) JOIN documents d USING (doc_id)""")
def norm_name(spark, d):
    t, kind = F.col("text"), F.lit("Character")
    return table(spark, d, "documents").select("doc_id", F.md5(text.norm_graph(t, kind)).alias("graph_name"), F.md5(text.norm_resolution(t, kind)).alias("resolution_name"), F.md5(text.norm_relation(t)).alias("relation_name"))


@query(r"""SELECT p_partkey, 'ent_' || left(p_brand, 8) || '_' || p_size || '_' || CASE WHEN s = '' THEN 'chunk' ELSE s END || '_' || p_partkey AS id
FROM (SELECT *, regexp_replace(regexp_replace(p_name, '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS s FROM part)""")
def slug_ids(spark, d):
    return table(spark, d, "part").select("p_partkey", text.compose_id("ent", F.col("p_brand"), F.col("p_size").cast("string"), F.col("p_name"), F.col("p_partkey").cast("string")).alias("id"))


@query(r"""WITH p AS (SELECT doc_id, text, CASE WHEN length(text) <= 1500 THEN 1 ELSE ceil((length(text) - 1500) / 1300.0)::INT + 1 END AS parts FROM documents),
w AS (SELECT doc_id, parts, unnest(range(0, parts))::INT AS part, text FROM p),
x AS (SELECT *, substring(text, part * 1300 + 1, 1500) AS win FROM w)
SELECT doc_id, part, CASE WHEN parts > 1 THEN doc_id || '_part_' || part ELSE doc_id::VARCHAR END AS window_id, length(win)::INT AS n_chars, md5(win) AS content FROM x
WHERE parts = 1 OR regexp_matches(win, '\S')""")
def chunk_windows(spark, d):
    out = corpus.chunk_windows(table(spark, d, "documents"), "text", "doc_id")
    return out.select("doc_id", "part", "window_id", F.length("window").alias("n_chars"), F.md5("window").alias("content"))


LINES_SQL = """lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1))::INT AS scene_no, text FROM documents),
scenes AS (SELECT doc_id, scene_no, line, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY scene_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS char_start, text FROM lines),
spans AS (SELECT *, coalesce(lead(char_start) OVER (PARTITION BY doc_id ORDER BY scene_no), length(text))::INT AS char_end FROM scenes)"""


@query(f"WITH {LINES_SQL} SELECT doc_id, scene_no, char_start, char_end, md5(substring(text, char_start + 1, char_end - char_start)) AS content FROM spans")
def scene_offsets(spark, d):
    return corpus.line_scenes(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "scene_no", "char_start", "char_end", F.md5("text").alias("content"))


@query("SELECT doc_id, md5(text) AS content, length(text)::INT AS n_chars, true AS same FROM documents")
def reconstruct_text(spark, d):
    docs = table(spark, d, "documents")
    rebuilt = corpus.line_scenes(docs, "doc_id", "text").groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("scene_no", "text"))), lambda x: x["text"]), "").alias("r"))
    return docs.join(rebuilt, "doc_id").select("doc_id", F.md5("r").alias("content"), F.length("r").alias("n_chars"), (F.col("r") == F.col("text")).alias("same"))


@query(r"""WITH h AS (SELECT doc_id, repeat('Running  head' || chr(10), 1 + (doc_id % 6)::INT) || text AS text FROM documents),
s AS (SELECT doc_id, lower(trim(regexp_replace(unnest(string_split(text, chr(10))), '\s+', ' ', 'g'))) AS signature FROM h)
SELECT doc_id, signature, count(*) AS n FROM s WHERE length(signature) BETWEEN 3 AND 60 AND NOT regexp_matches(signature, '[.!?;:]$') GROUP BY ALL HAVING count(*) >= 4""")
def repeated_headers(spark, d):
    """Texts that are given a running head, one to six times."""
    docs = table(spark, d, "documents").withColumn("text", F.concat(F.repeat(F.lit("Running  head\n"), (1 + F.col("doc_id") % 6).cast("int")), "text"))
    return corpus.repeated_headers(docs, "doc_id", "text")


@query(r"""SELECT page_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?m)[ \t\x0B\f\r]+$', '', 'g'), '\n{4,}', chr(10) || chr(10) || chr(10), 'g'), '^\s+', ''), '\s+$', '') || chr(10)) AS content FROM pages""")
def collapse_blank(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(corpus.collapse_blank(F.col("html"))).alias("content"))


@query(r"""WITH l AS (SELECT page_id, string_split(html, chr(10)) AS l FROM pages),
a AS (SELECT *, coalesce(list_position(list_transform(l, lambda x: regexp_matches(x, '(?i)<body')), true), 0) AS a FROM l),
t AS (SELECT page_id, a, l[a + 1 :] AS l FROM a), b AS (SELECT *, coalesce(list_position(list_transform(l, lambda x: regexp_matches(x, '(?i)</body')), true), 0) AS b FROM t)
SELECT page_id, md5(array_to_string(CASE WHEN b > 0 THEN l[1 : b - 1] ELSE l END, chr(10))) AS body, a > 0 AS start_found, b > 0 AS end_found FROM b""")
def marker_trim(spark, d):
    out = corpus.between_markers(table(spark, d, "pages"), "page_id", "html", "(?i)<body", "(?i)</body")
    return out.select("page_id", F.md5("body").alias("body"), "start_found", "end_found")


def _fix_sql(col: str) -> str:
    out = f"replace(replace(replace({col}, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(65279), '')"
    for bad, good in text.MOJIBAKE:
        codes = " || ".join(f"chr({ord(c)})" for c in bad)
        out = f"replace({out}, {codes}, '{good.replace(chr(39), chr(39) * 2)}')"
    return out


@query(f"SELECT doc_id, md5({_fix_sql('text')}) AS content FROM documents")
def encoding_fix(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.fix_encoding(F.col("text"))).alias("content"))


@query(r"""WITH w AS (SELECT doc_id, len(regexp_extract_all(unnest(string_split(text, chr(10))), '[\p{L}\p{N}_]+')) AS w FROM documents),
a AS (SELECT doc_id, count(*) AS n, round(avg(w), 1) AS mean, min(w)::INT AS least, max(w)::INT AS most, median(w) AS med FROM w GROUP BY doc_id)
SELECT doc_id, n, mean, least, most, med, array_to_string(list_filter([CASE WHEN n < 5 THEN 'fewer than 5 scenes' END, CASE WHEN n > 40 THEN 'more than 40 scenes' END,
  CASE WHEN med > 0 AND most > 3 * med THEN 'scene longer than 3x median' END], lambda x: x IS NOT NULL), '; ') AS flags FROM a""")
def scene_stats_flags(spark, d):
    counts = F.transform(F.split("text", "\n"), lambda x: text.word_count(x))
    rows = table(spark, d, "documents").select("doc_id", counts.alias("c")).withColumn("flags", F.array_join(corpus.review_flags(F.col("c")), "; "))
    lines = rows.select("doc_id", "flags", F.explode("c").alias("w"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("n"), F.round(F.avg("w"), 1).alias("mean"), F.min("w").alias("least"), F.max("w").alias("most"), F.median("w").alias("med"), F.first("flags").alias("flags"))


@query(rf"""WITH l AS (SELECT doc_id, lower(unnest(string_split(text, chr(10)))) AS line FROM documents)
SELECT doc_id, count(*) FILTER (regexp_matches(line, '(^|[^\p{{L}}\p{{N}}_])[0-9]+($|[^\p{{L}}\p{{N}}_])') OR list_has_any(regexp_extract_all(line, '[a-z0-9]+'), [{_in(text.DURABLE_TERMS)}])) AS durable, count(*) AS n_lines FROM l GROUP BY doc_id""")
def durable_facts(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(F.count_if(text.is_durable(F.col("line"))).alias("durable"), F.count("*").alias("n_lines"))


@query(rf"""WITH k AS (SELECT doc_id, list_distinct(list_filter(list_transform(list_filter(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+'), lambda x: regexp_full_match(x, '[A-Z][a-zA-Z][a-zA-Z]+')), lambda x: lower(x)),
lambda x: x NOT IN ({_in(text.DEDUPE_STOPWORDS)}))) AS k FROM documents) SELECT doc_id, len(k)::INT AS n, md5(array_to_string(list_sort(k), ' ')) AS keys FROM k""")
def entity_keys(spark, d):
    k = text.entity_keys(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(k).alias("n"), _digest(k).alias("keys"))


TERMS = ("the", "und", "les", "que", "license")


@query(rf"""WITH w AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+'), lambda x: lower(x)) AS w FROM documents), t AS (SELECT unnest([{_in(TERMS)}]) AS term),
c AS (SELECT doc_id, term, len(list_filter(w, lambda x: x = term)) AS n FROM w, t) SELECT doc_id, term, n::INT AS n FROM c WHERE n > 0""")
def survivor_hits(spark, d):
    """Terms that a renaming should have removed, with their counts in each text."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("story_id"), "text")
    hits = corpus.rename_stories(docs, [(t, t) for t in TERMS]).select(F.col("story_id").cast("long").alias("doc_id"), F.inline("survivors"))
    return hits.select("doc_id", "term", F.col("count").alias("n"))


@query()
def heuristic_split(spark, d):
    return table(spark, d, "documents").select("doc_id", corpus.heuristic_starts(F.col("text")).alias("starts")).select("doc_id", F.size("starts").alias("scenes"), F.array_join(F.col("starts").cast("array<string>"), ",").alias("starts"))


HEADS = "Chapter IV. The House\nFit the Third\nxii\nnot a heading\n"


@query(f"""WITH d AS (SELECT doc_id, replace('{HEADS.replace(chr(10), '@')}', '@', chr(10)) || 'Chapter ' || doc_id || chr(10) || text AS text FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1))::INT AS line_no FROM d)
SELECT doc_id, line_no, trim(line) AS heading FROM l WHERE regexp_matches(line, '\\S') AND regexp_matches(line, '{text.HEADING.replace("'", "''")}')""")
def heading_match(spark, d):
    """Headings of texts that are given some."""
    docs = table(spark, d, "documents").withColumn("text", F.concat(F.lit(HEADS), F.lit("Chapter "), F.col("doc_id").cast("string"), F.lit("\n"), "text"))
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.filter(F.col("line").rlike(r"\S") & F.col("line").rlike(text.HEADING)).select("doc_id", (F.col("line_no") + 1).alias("line_no"), F.trim("line").alias("heading"))


@query()
def segment_stories(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("story_id"), "text")
    return corpus.segment_stories(docs).select("story_id", "split_method", "scene", "heading", "char_start", "char_end", "word_count")


@query()
def clean_stories(spark, d):
    pages = table(spark, d, "pages").select(F.col("page_id").alias("story_id"), F.col("html").alias("text"))
    return corpus.clean_stories(pages).select("story_id", F.md5("cleaned").alias("cleaned"), "raw_words", "cleaned_words", "pct_removed", "start_found", "end_found")


NAMES = [{"original": "the", "replacement": "yon"}, {"original": "und", "replacement": "sowie", "variants": ["Und"], "variant_replacements": ["Sowie"]}]


@query()
def rename_stories(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("story_id"), "text")
    return corpus.rename_stories(docs, corpus.rename_pairs(NAMES)).select("story_id", F.md5("renamed").alias("renamed"), F.size("survivors").alias("survivors"))


@query("""WITH s AS (SELECT doc_id, (len(string_split(text, chr(10))))::INT AS scenes, ['5k', '10k', '15k'][1 + doc_id % 3] AS bucket FROM documents),
t AS (SELECT *, least(round_even(scenes * 0.6, 0)::INT, CASE bucket WHEN '5k' THEN 8 WHEN '10k' THEN 15 ELSE 20 END, scenes - 1) AS target FROM s)
SELECT doc_id, target, CASE WHEN target < 5 THEN 0 ELSE round_even(target * 0.4, 0)::INT END AS easy, CASE WHEN target < 5 THEN 0 ELSE greatest(1, round_even(target * 0.2, 0)::INT) END AS hard FROM t""")
def insertion_plan(spark, d):
    bucket = F.element_at(F.array(F.lit("5k"), F.lit("10k"), F.lit("15k")), (F.col("doc_id") % 3 + 1).cast("int"))
    out = table(spark, d, "documents").select("doc_id", corpus.target_insertions(F.size(F.split("text", "\n")), bucket).alias("target"))
    return out.select("doc_id", "target", corpus.difficulty_plan(F.col("target")).alias("p")).select("doc_id", "target", "p.easy", "p.hard")
