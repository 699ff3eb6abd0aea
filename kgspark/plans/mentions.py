"""Queries over the dictionary scan, with the SQL that they compare with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import mentions as m
from ..operators import text as t
from ..sources.adapters import table

#: Stand for left and right, which the texts don't have.
SIDES = ("the", "and")


def _names(spark: SparkSession, d: str) -> DataFrame:
    """Names of one to four words and abbreviations, from the words of benchmark items; some lie within others."""
    w = F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), 1)
    name = lambda start, n, kind: F.struct(F.array_join(F.slice("w", start, n), " ").alias("term"), F.lit(kind).alias("kind"))
    short = F.filter("w", lambda x: F.length(x) <= 3)
    every = F.array(name(1, 3, "canonical"), name(4, 1, "alias_en"), name(5, 2, "alias_en"), name(5, 4, "alias_cn"), F.struct(F.get(short, F.lit(0)).alias("term"), F.lit("alias_en").alias("kind")))
    return table(spark, d, "benchmark").select(F.col("item_id").alias("region_id"), w.alias("w")).select("region_id", F.explode(every).alias("n")).select("region_id", "n.term", "n.kind")


def _lexicon(spark: SparkSession, d: str) -> DataFrame:
    return m.region_lexicon(_names(spark, d))


def _sentences(spark: SparkSession, d: str) -> DataFrame:
    return t.sentences(table(spark, d, "documents"))


KEYS = ["doc_id", "sentence_id"]
QUERIES = {
    "region_lexicon": _lexicon,
    "region_hits": lambda s, d: m.scanned(_sentences(s, d), _lexicon(s, d), KEYS, SIDES),
    "region_mentions": lambda s, d: m.region_mentions(_sentences(s, d), _lexicon(s, d), KEYS, SIDES),
}

_LEX = """WITH w AS (SELECT item_id, regexp_extract_all(text, '[A-Za-z]+') AS w FROM benchmark),
  names AS (SELECT item_id AS region_id, trim(n.term) AS term, n.kind AS kind FROM (SELECT item_id, unnest([{'term': array_to_string(w[1:3], ' '), 'kind': 'canonical'}, {'term': array_to_string(w[4:4], ' '), 'kind': 'alias_en'},
    {'term': array_to_string(w[5:6], ' '), 'kind': 'alias_en'}, {'term': array_to_string(w[5:8], ' '), 'kind': 'alias_cn'}, {'term': list_filter(w, lambda x: length(x) <= 3)[1], 'kind': 'alias_en'}]) AS n FROM w)),
  kinds AS (SELECT region_id, term, regexp_full_match(term, '[A-Za-z]{2,3}') AS short, CASE WHEN regexp_full_match(term, '[A-Za-z]{2,3}') AND kind <> 'canonical' THEN 'alias_abbr' ELSE kind END AS kind FROM names WHERE length(term) >= 2),
  scored AS (SELECT *, CAST(CASE kind WHEN 'canonical' THEN 0.95 WHEN 'alias_en' THEN 0.85 WHEN 'alias_cn' THEN 0.8 ELSE 0.6 END AS DOUBLE) AS confidence FROM kinds),
  best AS (SELECT term, region_id, arg_max(kind, confidence) AS kind, max(confidence) AS confidence, bool_or(short) AS short FROM scored GROUP BY ALL),
  lex AS (SELECT term, region_id, kind, confidence, bool_or(short OR kind = 'alias_abbr') OVER (PARTITION BY term) AS cased FROM best)"""
_HITS = (
    _LEX
    + """, needle AS (SELECT needle, cased, unnest(e) FROM (SELECT CASE WHEN cased THEN term ELSE lower(term) END AS needle, cased, arg_min({'region_id': region_id, 'kind': kind, 'confidence': confidence, 'term': lower(term)}, {'o': -confidence, 'r': region_id}) AS e FROM lex GROUP BY ALL)),
  cut AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS s FROM documents),
  sent AS (SELECT doc_id, CAST(unnest(range(len(s))) AS INTEGER) AS sentence_id, unnest(s) AS sentence FROM cut),
  near AS (SELECT doc_id, sentence_id, CASE WHEN cased THEN sentence ELSE lower(sentence) END AS txt, n.* FROM sent JOIN needle n ON contains(CASE WHEN cased THEN sentence ELSE lower(sentence) END, needle)),
  place AS (SELECT *, unnest(list_filter(range(1, length(txt) - length(needle) + 2), lambda i: substring(txt, i, length(needle)) = needle)) - 1 AS pos FROM near),
  hit AS (SELECT doc_id, sentence_id, [{'pos': CAST(pos AS INTEGER), 'end': CAST(pos + length(needle) AS INTEGER), 'term': term, 'region_id': region_id, 'kind': kind, 'confidence': confidence}] AS h FROM place
    WHERE NOT cased OR NOT (regexp_matches(CASE WHEN pos > 0 THEN substring(txt, pos, 1) ELSE '' END, '[A-Za-z0-9]') OR regexp_matches(substring(txt, pos + length(needle) + 1, 1), '[A-Za-z0-9]'))),
  lists AS (SELECT doc_id, sentence_id, list(h ORDER BY h[1].pos, h[1].pos - h[1]."end", -h[1].confidence, h[1].region_id) AS hs FROM hit GROUP BY ALL),
  kept AS (SELECT doc_id, sentence_id, unnest(list_reduce(hs, lambda k, h: CASE WHEN h[1].pos >= k[-1]."end" THEN k || h WHEN h[1]."end" - h[1].pos > k[-1]."end" - k[-1].pos THEN k[:-2] || h ELSE k END)) AS h FROM lists),
  sided AS (SELECT doc_id, sentence_id, h.*, regexp_extract(substring(sentence, greatest(h.pos - 30, 0) + 1, h."end" + 30 - greatest(h.pos - 30, 0)), '\\b(the|and)s?\\-?(hemisphere|sided|side)?\\b', 1) AS found FROM kept JOIN sent USING (doc_id, sentence_id)),
  hits AS (SELECT doc_id, sentence_id, pos, "end", term, region_id, kind, confidence, CASE WHEN found = '' THEN 'unspecified' ELSE found END AS laterality FROM sided)"""
)
ORACLE_SQL = {
    "region_lexicon": f"{_LEX} SELECT * FROM lex",
    "region_hits": f"{_HITS} SELECT * FROM hits",
    "region_mentions": f"{_HITS} SELECT * EXCLUDE k FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, sentence_id, region_id ORDER BY confidence DESC, pos) AS k FROM hits) WHERE k = 1",
}
