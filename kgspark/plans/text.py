"""Queries over the text and resolution operators, with the SQL that they compare with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.columns import core_term, doi_key, edge_id, first_keyword, first_label, normal_name, slug
from ..operators import passages as ps
from ..operators import resolve as r
from ..operators import text as t
from ..sources.adapters import regions, table

WORD = "[a-z]{6,}"
SPECIES = {"human": ["than", "inand"], "primate": ["reon"], "rodent": ["sh"]}


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text", "lang", "source")


def _english(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).where("lang = 'en'")


def _lexicon(spark: SparkSession, d: str) -> DataFrame:
    return t.lexicon(_english(spark, d), WORD, 5, 60, 200)


def _mentions(spark: SparkSession, d: str) -> DataFrame:
    return t.scan(t.sentences(_english(spark, d)), _lexicon(spark, d), WORD)


def _cited(spark: SparkSession, d: str) -> DataFrame:
    """Passages and the documents in which their first five words stand somewhere."""
    w = F.split(F.trim("text"), r"\s+")
    items = table(spark, d, "benchmark").select("item_id", F.array_join(F.slice(w, 1, 5), " ").alias("lead"))
    words = _docs(spark, d).select("doc_id", F.posexplode(w).alias("k", "word"))
    run = Window.partitionBy("doc_id").orderBy("k")
    posted = words.select("doc_id", F.concat_ws(" ", "word", *[F.lead("word", n).over(run) for n in range(1, 5)]).alias("lead"))
    return items.join(posted, "lead").select("item_id", "doc_id").distinct()


def _support(spark: SparkSession, d: str) -> DataFrame:
    m = _mentions(spark, d)
    pairs = t.cooccurrence(m, 10).where("level = 'same_sentence'").select("lo", "hi").distinct()
    return t.support_sentences(m, pairs)


def _index(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    word = F.element_at(F.split("p_name", " "), -1)
    return r.name_index(
        ("exact", part.select("p_name", "p_partkey")),
        ("normal", part.select(normal_name(F.col("p_brand")), "p_partkey")),
        ("alias", part.select(word, "p_partkey")),
    )


def _questions(spark: SparkSession, d: str) -> DataFrame:
    """Names to resolve, each with the keys that it may be found by."""
    part = table(spark, d, "part")
    names = part.select("p_name").union(part.select(F.upper("p_brand"))).union(part.select(F.concat(F.lit("old "), F.element_at(F.split("p_name", " "), -1)))).union(part.select("p_type")).toDF("query").distinct()
    keys = F.array_distinct(F.array("query", normal_name(F.col("query")), F.element_at(F.split("query", " "), -1)))
    return names.select("query", F.explode(keys).alias("key"))


def _columns(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    return part.select(
        "p_partkey",
        slug(F.concat_ws(" ", "p_name", "p_brand")).alias("slug"),
        edge_id(F.col("p_name"), F.col("p_brand"), F.col("p_type"), longest=28).alias("edge_id"),
        first_label(F.nullif("p_name", F.lit("red widget")), F.col("p_brand")).alias("label"),
        core_term(F.col("p_name"), ["small", "large", "red"]).alias("core"),
        doi_key(F.concat(F.lit("https://doi.org/10.1000/"), F.upper("p_brand"))).alias("doi"),
        F.sha2(normal_name(F.col("p_name")), 256).alias("content_hash"),
    )


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("paragraph_id", "paragraph"))


QUERIES = {
    "sentences": lambda s, d: t.sentences(_docs(s, d)),
    "lexicon": _lexicon,
    "dictionary_scan": _mentions,
    "cooccurrence": lambda s, d: t.cooccurrence(_mentions(s, d), 10),
    "support_sentences": _support,
    "sentence_neighbours": lambda s, d: t.neighbours(t.sentences(_english(s, d))),
    "paragraph_scores": lambda s, d: t.paragraph_scores(t.paragraphs(_english(s, d)), "than", "inthe", "of"),
    "passage_verification": lambda s, d: t.verify_passages(table(s, d, "benchmark"), _docs(s, d), _cited(s, d)),
    "passage_matches": lambda s, d: ps.passage_matches(table(s, d, "benchmark"), _docs(s, d)),
    "passage_tiers": lambda s, d: ps.passage_matches(table(s, d, "benchmark"), _docs(s, d)).where("status <> 'similarity'").select("item_id", "doc_id", "status"),
    "passage_recall": lambda s, d: ps.recalled(_blocks(s, d), "the heron of inthe"),
    "trigram_similarity": lambda s, d: t.similar_names(table(s, d, "part").select(F.col("p_name").alias("name")), 0.3),
    "term_recommendations": lambda s, d: t.term_recommendations(table(s, d, "part").select(F.col("p_name").alias("query")), table(s, d, "part").select(F.concat_ws(" ", F.element_at(F.split("p_name", " "), -1), F.lower("p_type")).alias("term"))),
    "page_titles": lambda s, d: t.page_titles(table(s, d, "pages")),
    "species_detection": lambda s, d: _docs(s, d).select("doc_id", first_keyword(F.col("text"), SPECIES, "unknown").alias("species")),
    "cascade_resolution": lambda s, d: r.cascade(_questions(s, d), _index(s, d)),
    "entity_resolver": lambda s, d: r.resolve(_questions(s, d), _index(s, d)),
    "unordered_pair_join": lambda s, d: r.unordered_match(
        regions(s, d).select(F.col("name").alias("a"), F.concat(F.lit("NATION_"), (F.col("region_id") + 3).cast("string")).alias("b")),
        regions(s, d).select(F.concat(F.lit("NATION_"), (F.col("region_id") * 2).cast("string")).alias("a"), F.concat(F.lit("NATION_"), (F.col("region_id") * 2 + 3).cast("string")).alias("b")),
    ),
    "identity_columns": _columns,
}

_SENT = "WITH cut AS (SELECT doc_id, lang, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS s FROM documents), sent AS (SELECT doc_id, lang, CAST(unnest(range(len(s))) AS INTEGER) AS sentence_id, unnest(s) AS sentence FROM cut)"
_LEX = _SENT + f", lex AS (SELECT term, count(*) AS df FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '{WORD}'))) AS term FROM documents WHERE lang = 'en') GROUP BY term HAVING count(*) BETWEEN 5 AND 60 ORDER BY df DESC, term LIMIT 200)"
_SCAN = _LEX + f", mention AS (SELECT doc_id, sentence_id, term, count(*) AS hits FROM (SELECT doc_id, sentence_id, unnest(regexp_extract_all(sentence, '{WORD}')) AS term FROM sent WHERE lang = 'en') JOIN lex USING (term) GROUP BY ALL)"
_CO = (
    _SCAN
    + """, best AS (SELECT a.doc_id, a.term AS lo, b.term AS hi, min({'l': CASE WHEN a.sentence_id = b.sentence_id THEN 0 WHEN a.sentence_id // 10 = b.sentence_id // 10 THEN 1 ELSE 2 END, 's': a.sentence_id}) AS m
    FROM mention a JOIN mention b ON a.doc_id = b.doc_id AND a.term < b.term GROUP BY ALL),
  co AS (SELECT doc_id, lo, hi, CASE m.l WHEN 0 THEN 'same_sentence' WHEN 1 THEN 'same_section' ELSE 'same_paper' END AS level, CAST(CASE m.l WHEN 0 THEN 0.8 WHEN 1 THEN 0.6 ELSE 0.4 END AS DOUBLE) AS score, m.s AS sentence_id FROM best)"""
)
_NORMAL = "trim(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
_SPACED = "trim(lower(regexp_replace(text, '\\s+', ' ', 'g')))"
_UNICODE = f"trim(lower(regexp_replace(regexp_replace(nfc_normalize(text), '{ps.HYPHENS}', '-', 'g'), '{ps.SPACES}', ' ', 'g')))"
_RESOLVE = f"""WITH idx AS (SELECT DISTINCT p_name AS key, 'exact' AS method, 0 AS priority, p_partkey AS entity FROM part UNION SELECT {_NORMAL.format('p_brand')}, 'normal', 1, p_partkey FROM part UNION SELECT split_part(p_name, ' ', -1), 'alias', 2, p_partkey FROM part),
  q AS (SELECT DISTINCT unnest([p_name, upper(p_brand), 'old ' || split_part(p_name, ' ', -1), p_type]) AS query FROM part),
  k AS (SELECT DISTINCT query, unnest([query, {_NORMAL.format('query')}, split_part(query, ' ', -1)]) AS key FROM q), hit AS (SELECT query, method, priority, entity FROM k JOIN idx USING (key)),
  low AS (SELECT query, min(priority) AS p FROM hit GROUP BY query), got AS (SELECT h.query, h.method, count(DISTINCT entity) AS n, min(entity) AS e FROM hit h JOIN low ON h.query = low.query AND h.priority = low.p GROUP BY ALL)"""
ORACLE_SQL = {
    "sentences": f"{_SENT} SELECT doc_id, sentence_id, sentence FROM sent",
    "lexicon": f"{_LEX} SELECT * FROM lex",
    "dictionary_scan": f"{_SCAN} SELECT * FROM mention",
    "cooccurrence": f"{_CO} SELECT * FROM co",
    "support_sentences": f"{_CO}, p AS (SELECT DISTINCT lo, hi FROM co WHERE level = 'same_sentence') SELECT a.doc_id, lo, hi, min(a.sentence_id) AS sentence_id FROM p JOIN mention a ON a.term = lo JOIN mention b ON b.term = hi AND a.doc_id = b.doc_id AND a.sentence_id = b.sentence_id GROUP BY ALL",
    "sentence_neighbours": f"{_SENT} SELECT doc_id, sentence_id, CAST(length(sentence) AS INTEGER) AS size, CAST(lag(length(sentence)) OVER w AS INTEGER) AS before, CAST(lead(length(sentence)) OVER w AS INTEGER) AS behind FROM sent WHERE lang = 'en' WINDOW w AS (PARTITION BY doc_id ORDER BY sentence_id)",
    "paragraph_scores": """WITH p AS (SELECT doc_id, CAST(unnest(range(len(x))) AS INTEGER) AS paragraph_id, lower(unnest(x)) AS g FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE lang = 'en')),
      h AS (SELECT doc_id, paragraph_id, len(regexp_extract_all(g, '\\bthan\\b')) AS s, len(regexp_extract_all(g, '\\binthe\\b')) AS t, len(regexp_extract_all(g, '\\bof\\b')) AS r FROM p WHERE g <> ''),
      c AS (SELECT doc_id, paragraph_id, CAST(CASE WHEN s > 0 THEN 20 ELSE 0 END + CASE WHEN t > 0 THEN 20 ELSE 0 END + least(r * 6, 18) + CASE WHEN s > 0 AND t > 0 THEN 30 ELSE 0 END AS INTEGER) AS score FROM h) SELECT * FROM c WHERE score > 0""",
    "passage_verification": """WITH w AS (SELECT doc_id, regexp_split_to_array(trim(text), '\\s+') AS w FROM documents), r AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS lead FROM w),
      lead AS (SELECT DISTINCT item_id, doc_id FROM (SELECT item_id, array_to_string((regexp_split_to_array(trim(text), '\\s+'))[1:5], ' ') AS lead FROM benchmark) JOIN r USING (lead)),
      j AS (SELECT item_id, doc_id, b.text AS passage, d.text AS text, list_distinct(regexp_extract_all(lower(b.text), '[a-z]+')) AS own, list_distinct(regexp_extract_all(lower(d.text), '[a-z]+')) AS there FROM lead JOIN benchmark b USING (item_id) JOIN documents d USING (doc_id))
      SELECT item_id, doc_id, CASE WHEN contains(text, passage) THEN 'exact' WHEN contains(trim(regexp_replace(text, '\\s+', ' ', 'g')), trim(regexp_replace(passage, '\\s+', ' ', 'g'))) THEN 'whitespace'
        WHEN len(list_intersect(own, there)) / greatest(len(own), 1) >= 0.8 THEN 'similar' ELSE 'none' END AS status FROM j""",
    "passage_tiers": f"""WITH b AS (SELECT item_id, text, {_SPACED} AS ws, {_UNICODE} AS nf FROM benchmark), d AS (SELECT doc_id, text, {_SPACED} AS ws, {_UNICODE} AS nf FROM documents)
      SELECT item_id, doc_id, CASE WHEN contains(d.text, b.text) THEN 'exact' WHEN contains(d.ws, b.ws) THEN 'normalized_whitespace' ELSE 'normalized_unicode' END AS status FROM b JOIN d ON contains(d.text, b.text) OR contains(d.ws, b.ws) OR contains(d.nf, b.nf)""",
    "passage_recall": """WITH p AS (SELECT doc_id, CAST(unnest(range(len(x))) AS INTEGER) AS paragraph_id, lower(unnest(x)) AS g FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
      h AS (SELECT doc_id, paragraph_id, contains(g, 'the')::INT + contains(g, 'heron')::INT + contains(g, 'of')::INT + contains(g, 'inthe')::INT AS hits FROM p), b AS (SELECT doc_id, arg_min(paragraph_id, {'h': -hits, 'p': paragraph_id}) AS best FROM h GROUP BY doc_id),
      o AS (SELECT h.*, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN paragraph_id = best THEN 0 WHEN abs(paragraph_id - best) <= 1 THEN 1 ELSE 2 END, CASE WHEN abs(paragraph_id - best) = 1 THEN 0 ELSE -hits END, paragraph_id) AS INTEGER) AS place FROM h JOIN b USING (doc_id)) SELECT * FROM o WHERE place <= 30""",
    "trigram_similarity": """WITH n AS (SELECT DISTINCT p_name AS name FROM part), w AS (SELECT name, '  ' || unnest(string_split(name, ' ')) || ' ' AS w FROM n),
      g AS (SELECT DISTINCT name, w[i:i+2] AS gram FROM (SELECT name, w, unnest(range(1, CAST(length(w) - 1 AS BIGINT))) AS i FROM w)), c AS (SELECT name, count(*) AS n FROM g GROUP BY name),
      p AS (SELECT a.name AS lo, b.name AS hi, count(*) AS s FROM g a JOIN g b ON a.gram = b.gram AND a.name < b.name GROUP BY ALL)
      SELECT lo, hi, round(s / (x.n + y.n - s), 4) AS similarity FROM p JOIN c x ON x.name = lo JOIN c y ON y.name = hi WHERE round(s / (x.n + y.n - s), 4) >= 0.3""",
    "term_recommendations": """WITH q AS (SELECT DISTINCT p_name AS query, list_distinct(regexp_extract_all(lower(p_name), '[a-z]+')) AS w FROM part), t AS (SELECT DISTINCT split_part(p_name, ' ', -1) || ' ' || lower(p_type) AS term FROM part), u AS (SELECT term, list_distinct(regexp_extract_all(lower(term), '[a-z]+')) AS w FROM t),
      s AS (SELECT query, term, round(len(list_intersect(q.w, u.w)) / greatest(len(q.w), len(u.w)), 4) AS score FROM q, u WHERE len(list_intersect(q.w, u.w)) > 0), k AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, term) AS INTEGER) AS k FROM s WHERE score >= 0.4) SELECT * FROM k WHERE k <= 3""",
    "page_titles": "SELECT page_id, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title, regexp_extract(html, '<html lang=\"([a-z]+)\"', 1) AS lang, len(regexp_extract_all(html, '<a href=')) AS links, len(regexp_extract_all(html, '<p>')) AS paragraphs FROM pages",
    "species_detection": "SELECT doc_id, CASE WHEN contains(lower(text), 'than') OR contains(lower(text), 'inand') THEN 'human' WHEN contains(lower(text), 'reon') THEN 'primate' WHEN contains(lower(text), 'sh') THEN 'rodent' ELSE 'unknown' END AS species FROM documents",
    "cascade_resolution": f"{_RESOLVE} SELECT q.query, e AS entity, coalesce(method, 'unresolved') AS method FROM q LEFT JOIN got ON got.query = q.query",
    "entity_resolver": f"{_RESOLVE} SELECT q.query, CASE WHEN n IS NULL THEN 'unresolved' WHEN n > 1 THEN 'ambiguous' ELSE 'resolved' END AS status, method, coalesce(n, 0) AS candidates, CASE WHEN n = 1 THEN e END AS entity FROM q LEFT JOIN got ON got.query = q.query",
    "unordered_pair_join": "WITH p AS (SELECT n_name AS a, 'NATION_' || (n_nationkey + 3) AS b FROM nation), k AS (SELECT 'NATION_' || (n_nationkey * 2) AS a, 'NATION_' || (n_nationkey * 2 + 3) AS b FROM nation) SELECT a, b, least(a, b) AS lo, greatest(a, b) AS hi FROM p WHERE (least(a, b), greatest(a, b)) IN (SELECT (least(a, b), greatest(a, b)) FROM k)",
    "identity_columns": f"""SELECT p_partkey, regexp_replace(regexp_replace(lower(trim(p_name || ' ' || p_brand)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug,
      CASE WHEN length(p_name || ':' || p_brand || ':' || p_type) > 28 THEN left(sha256(p_name || ':' || p_brand || ':' || p_type), 16) ELSE p_name || ':' || p_brand || ':' || p_type END AS edge_id,
      CASE WHEN p_name = 'red widget' THEN p_brand ELSE p_name END AS label,
      array_to_string(list_filter(string_split({_NORMAL.format('p_name')}, ' '), lambda x: x NOT IN ('', 'small', 'large', 'red')), ' ') AS core,
      '10.1000/' || lower(p_brand) AS doi, sha256({_NORMAL.format('p_name')}) AS content_hash FROM part""",
}
