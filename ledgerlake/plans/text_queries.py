"""Queries of marked texts, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerlake.operators import text as X


def tx02_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of conversations, whose lines get marks here and there by their words, since the test data has few."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").selectExpr("conv_id * 1000 + turn AS id", f"{_MARKED} AS text")
    return X.runs(rows, "id", "text")


#: Words that are put between marks, in both engines alike: an ending that is common, one after the other.
_MARKED = "text"
for _word, _by in (("the ", "**the** "), ("ing ", "ing *x* "), ("er ", "er_ `a*b`"), (". ", "._y_ ~~gone "), (", ", ",__ z"), ("on ", "on~~ *"), ("a", "a")):
    _MARKED = f"replace({_MARKED}, '{_word}', '{_by}')"

QUERIES = {"tx02_runs": tx02_runs}

#: Of a star or a low line, whether it may open a pair and close one: both, opens, closes, neither.
_KINDS = ("\x01", "\x02", "\x03", "\x04")


def _prepared(t: str, mark: str) -> str:
    """t with the marks that may open or close replaced by signs of their own, since SQL has no look-around."""
    m, word = ("\\*", "*") if mark == "*" else ("_", "_")
    both, opens, closes, neither = _KINDS
    after = "[^*]" if mark == "*" else "[^0-9A-Za-z_]"
    out = f"regexp_replace({t}, '(^|[^{word}0-9A-Za-z_]){m}', '\\1{opens}', 'g')"
    # A mark that may open is never followed by another that may, so what follows it can be used up, and so for the rest.
    stop = after[:-1] + opens + "]" if mark == "_" else after
    out = f"regexp_replace({out}, '{opens}({stop}|$)', '{both}\\1', 'g')"
    return f"replace(regexp_replace({out}, '{m}({stop}|$)', '{closes}\\1', 'g'), '{mark}', '{neither}')"


def _level(k: int, pattern: str, length: int, name: str, prepared: str | None) -> str:
    """Pieces p<k + 1> of p<k>: gaps and pairs in turn, told apart by the parity of the last place."""
    text = f"{prepared.format('text')}" if prepared else "text"
    back = (lambda t: "".join(["replace(" * 4, t, *(f", '{c}', '{'*' if '*' in prepared else '_'}')" for c in _KINDS)])) if prepared else (lambda t: t)
    return f"""s{k} AS (SELECT id, path, marks, text, {text} AS t FROM p{k}),
g{k} AS (SELECT id, path, marks, text, CASE WHEN list_contains(marks, 'code') THEN [t] ELSE string_split_regex(t, '{pattern}') END AS gaps, CASE WHEN list_contains(marks, 'code') THEN [] ELSE regexp_extract_all(t, '{pattern}') END AS pairs FROM s{k}),
p{k + 1} AS (SELECT id, list_append(path, i) AS path, marks, {back("x")} AS text FROM (SELECT id, path, marks, unnest(gaps) AS x, 2 * generate_subscripts(gaps, 1) - 1 AS i FROM g{k}) a
  UNION ALL SELECT id, list_append(path, i), list_append(marks, '{name}'), {back("x")} FROM (SELECT id, path, marks, unnest(list_transform(pairs, lambda m: m[{length + 1}:-{length + 1}])) AS x, 2 * generate_subscripts(pairs, 1) AS i FROM g{k}) b)"""


def _runs_sql() -> str:
    both, opens, closes, neither = _KINDS
    single = f"[{both}{opens}][^{both}{opens}{closes}{neither}\n]+[{both}{closes}]"
    patterns = [("`[^`]+`", None), ("(?s)\\*\\*.+?\\*\\*", None), ("(?s)__.+?__", None), ("~~[^~]+~~", None), (single, "*"), (single, "_")]
    levels = [_level(k, p, length, name, m and _prepared("{0}", m)) for k, ((p, m), (_, length, name)) in enumerate(zip(patterns, X.MARKS, strict=True))]
    return f"WITH p0 AS (SELECT conv_id * 1000 + turn AS id, CAST([] AS BIGINT[]) AS path, CAST([] AS VARCHAR[]) AS marks, {_MARKED} AS text FROM conversations), " + ", ".join(levels) + " SELECT id, row_number() OVER (PARTITION BY id ORDER BY path) - 1 AS place, text, array_to_string(list_sort(list_distinct(marks)), ',') AS marks FROM p6 WHERE text <> ''"


ORACLE_SQL = {"tx02_runs": _runs_sql()}
