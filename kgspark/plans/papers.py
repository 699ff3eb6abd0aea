"""Queries over the paper operators, with the SQL that they compare with.

``paper_dedup`` has none: SQL can't express it, a test holds it against a plain
loop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import papers as p
from ..operators import text as t
from ..sources.adapters import table


def _papers(spark: SparkSession, d: str) -> DataFrame:
    """Events as papers: a time and type as one key, a user and a value as the other; some are empty."""
    events = table(spark, d, "events")
    pmid = F.when(F.col("event_type") != "error", F.concat_ws(":", "user_id", "event_type"))
    doi = F.concat_ws("/", F.date_format("ts", "yyyyMMddHH"), F.col("user_id").cast("string"))
    return events.select("event_id", pmid.alias("pmid"), doi.alias("doi"))


def _citing(spark: SparkSession, d: str) -> DataFrame:
    """Sentences about parts that cite by the words of their names, in both forms and in company."""
    word = lambda k: F.initcap(F.element_at(F.split("p_name", " "), k))
    year = F.col("p_size") + 1900
    text = F.concat(
        F.lit("They follow "), word(1), F.lit(" et al. ("), year, F.lit("), not all (see below), but ("), word(1), F.lit(" & "), word(2), F.lit(", "), year + 50, F.lit("b; "), word(2), F.lit(", K.L., "), year + 60, F.lit("), in 1999.")
    )
    return table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), text.alias("text"))


def _matches(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    year = (F.col("p_size") + 1950).cast("string")
    library = part.groupBy(F.col("p_name").alias("authors"), year.alias("year")).agg(F.min("p_partkey").alias("paper"))
    return p.match_citations(part.select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit(" et al.")).alias("author"), F.concat(year, F.lit("a")).alias("year")), library)


def _screened(spark: SparkSession, d: str) -> DataFrame:
    paragraphs = t.paragraphs(table(spark, d, "documents").where("lang = 'en'"))
    cut = t.sentences(paragraphs, "doc_id", "paragraph_id", text="paragraph")
    return p.screen(cut, r"\bwas\b", r"\bwith\b", r"\bof\b")


QUERIES = {
    "citations": lambda s, d: p.citations(_citing(s, d)).select("doc_id", "author", "year"),
    "citation_matches": _matches,
    "paper_dedup": lambda s, d: p.first_papers(_papers(s, d), "event_id").select("event_id"),
    "longest_passages": lambda s, d: p.longest_passages(table(s, d, "conversations"), ["conv_id", "role"], "text", "turn").select("conv_id", "role", "turn"),
    "semantic_blocks": lambda s, d: p.semantic_blocks(table(s, d, "documents")),
    "paragraph_screening": _screened,
}

_CUT = "list_filter(list_transform(string_split(regexp_replace({0}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')"
_AT = "CASE WHEN regexp_matches(lower(sentence), '\\b{0}\\b') THEN length(string_split_regex(lower(sentence), '\\b{0}\\b')[1]) + 1 ELSE 0 END"
_WORD = "upper(substr(string_split(p_name, ' ')[{0}], 1, 1)) || substr(string_split(p_name, ' ')[{0}], 2)"
ORACLE_SQL = {
    "citations": f"""WITH w AS (SELECT p_partkey AS doc_id, {_WORD.format(1)} AS a, {_WORD.format(2)} AS b, p_size + 1900 AS y FROM part)
      SELECT doc_id, a || ' et al.' AS author, CAST(y AS VARCHAR) AS year FROM w UNION ALL SELECT doc_id, a || ' & ' || b, (y + 50) || 'b' FROM w UNION ALL SELECT doc_id, b || ', K.L.', CAST(y + 60 AS VARCHAR) FROM w""",
    "citation_matches": """WITH l AS (SELECT p_name AS authors, p_size + 1950 AS year, min(p_partkey) AS paper FROM part GROUP BY ALL), w AS (SELECT DISTINCT paper, year, unnest(string_split(lower(authors), ' ')) AS name FROM l),
      c AS (SELECT DISTINCT p_partkey AS id, p_size + 1950 AS year, unnest(string_split(lower(p_name), ' ')) AS name FROM part), h AS (SELECT id, count(DISTINCT paper) AS n, min(paper) AS paper FROM c JOIN w USING (year, name) GROUP BY id)
      SELECT p_partkey AS id, coalesce(n, 0) AS matches, CASE WHEN n = 1 THEN 'A_unique' WHEN n > 1 THEN 'B_multiple' ELSE 'C_local_unmatched' END AS grade, CASE WHEN n = 1 THEN paper END AS paper FROM part LEFT JOIN h ON h.id = p_partkey""",
    "longest_passages": "SELECT conv_id, role, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY length(text) DESC NULLS LAST, turn) AS k FROM conversations) WHERE k = 1",
    "semantic_blocks": """WITH RECURSIVE q AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13)) <> '') AS x FROM documents), p AS (SELECT doc_id, unnest(range(len(x))) AS k, length(unnest(x)) AS n FROM q),
      r AS (SELECT doc_id, k, 0 AS block, n AS held, n FROM p WHERE k = 0 UNION ALL SELECT p.doc_id, p.k, CASE WHEN r.held >= 800 THEN r.block + 1 ELSE r.block END, CASE WHEN r.held >= 800 THEN p.n ELSE r.held + p.n END, p.n FROM r JOIN p ON p.doc_id = r.doc_id AND p.k = r.k + 1)
      SELECT doc_id, CAST(block AS INTEGER) AS block, CAST(min(k) AS INTEGER) AS first, count(*) AS paragraphs, CAST(sum(n) AS BIGINT) AS chars FROM r GROUP BY doc_id, block""",
    "paragraph_screening": f"""WITH p AS (SELECT doc_id, CAST(unnest(range(len(x))) AS INTEGER) AS paragraph_id, unnest(x) AS g FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE lang = 'en')),
      c AS (SELECT doc_id, paragraph_id, {_CUT.format('g')} AS s FROM p WHERE g <> ''), e AS (SELECT doc_id, paragraph_id, CAST(unnest(range(len(s))) AS INTEGER) AS sentence_id, unnest(s) AS sentence FROM c),
      a AS (SELECT doc_id, paragraph_id, sentence_id, {_AT.format('was')} AS s, {_AT.format('with')} AS t, regexp_matches(lower(sentence), '\\bof\\b') AS r FROM e),
      n AS (SELECT *, s > 0 AND t > 0 AND r AS strong, s > 0 AND t = 0 AND ((coalesce(lag(t) OVER w, 0) > 0 AND (r OR coalesce(lag(r) OVER w, false))) OR (coalesce(lead(t) OVER w, 0) > 0 AND (r OR coalesce(lead(r) OVER w, false)))) AS near FROM a WINDOW w AS (PARTITION BY doc_id, paragraph_id ORDER BY sentence_id)),
      g AS (SELECT doc_id, paragraph_id, bool_or(strong OR near) AS found, bool_or(r) AS rel, bool_or(t > 0) AS has, min(sentence_id) FILTER (s > 0) AS head FROM n GROUP BY ALL),
      f AS (SELECT n.*, CASE WHEN strong THEN 'same_sentence' WHEN near THEN 'adjacent_sentence' WHEN NOT found AND rel AND has AND sentence_id = head THEN 'same_paragraph' END AS proximity FROM n JOIN g USING (doc_id, paragraph_id))
      SELECT doc_id, paragraph_id, sentence_id, CASE WHEN strong THEN 'strong' ELSE 'medium' END AS level, proximity, CAST(CASE WHEN strong AND s < t THEN 0.9 WHEN strong THEN 0.86 WHEN near THEN 0.65 ELSE 0.58 END AS DOUBLE) AS confidence FROM f WHERE proximity IS NOT NULL""",
}
