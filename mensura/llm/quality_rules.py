"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

The metrics of a text are computed by built-in functions only, the table RULES is folded into one boolean
expression, and the whole is one map-side projection: no shuffle, no Python.

Defined results: a null text counts as a text without words (n_words 0, base_failed, not kept); a text of any
length is read whole; repeated rows and rows of equal text get equal verdicts each; an empty table gives an
empty result; columns of the input that bear the name of a metric are replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, beside, text_of

#: Common function words of English, German, French and Spanish.
STOP_WORDS = (
    "the and of to in is it that for with as are on be this by from was at or an a "
    "der die das und den von zu mit sich des auf ist im dem nicht ein eine "
    "le la les de et des un une du en que qui dans pour par sur au est pas avec "
    "el los las y se con no para su del una lo por"
).split()
#: The threshold table: (rule, ratio, least, most, words from which it holds); a text passes if every ratio lies within.
RULES = (
    ("word length", "mean_word_chars", 2.0, 12.0, 0),
    ("symbols per word", "symbol_ratio", 0.0, 0.1, 0),
    ("stop words per word", "stop_ratio", 0.02, None, 50),
    ("repeated lines per line", "dup_line_ratio", 0.0, 0.6, 0),
    ("words a text", "n_words", 10, None, 0),
)


def _let(value: Column, body) -> Column:
    """body of value, with value computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeat_words(words: Column) -> Column:
    """Words covered by 5-word windows that occur twice or more in the text.

    Windows are compared by 64-bit hashes. Most texts have no repeat, which a distinct count of the hashes tells;
    else equal hashes meet by sorting (hash, place), and the places' windows are merged from left to right.
    """
    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - 4), lambda i: F.xxhash64(F.slice(words, i, 5)))

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        def repeated(s: Column) -> Column:
            same = lambda x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
            return F.sort_array(F.transform(F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]))
        merged = lambda p: F.aggregate(
            p,
            F.struct(F.lit(0).alias("n"), F.lit(-5).alias("last")),
            lambda a, x: F.struct((a["n"] + F.least(F.lit(5), x - a["last"])).alias("n"), x.alias("last")),
            lambda a: a["n"],
        )
        return merged(_let(pairs, repeated))

    found = _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
    return F.when(F.size(words) >= 6, found).otherwise(F.lit(0))


def metrics(text: Column) -> dict[str, Column]:
    """The metrics of a text that is not null, as one struct of words and lines read once each."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    by_words = _let(
        words,
        lambda w: F.struct(
            F.size(w).alias("n"),
            repeat_words(w).alias("rep"),
            F.size(F.filter(w, lambda x: F.lower(F.regexp_replace(x, r"[^\p{L}]+", "")).isin(*STOP_WORDS))).alias("stop"),
        ),
    )
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    by_lines = _let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    return {
        "words": by_words,
        "lines": by_lines,
        "word_chars": F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
    }


def verdict(rules: tuple = RULES) -> Column:
    """The threshold table as one expression over the columns named in it."""
    out = F.lit(True)
    for _, ratio, least, most, words in rules:
        value = F.col(ratio)
        test = F.lit(True)
        if least is not None:
            test = test & (value >= least)
        if most is not None:
            test = test & (value <= most)
        out = out & ((F.col("n_words") < words) | F.coalesce(test, F.lit(False)))
    return out


def quality_rules(docs: DataFrame, text: str = "text", rules: tuple = RULES) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, the ratios of the table, base_failed and kept."""
    m = metrics(text_of(text))
    ready = docs.select("*", F.struct(*(v.alias(k) for k, v in m.items())).alias("__m"))
    n, lines = F.col("__m.words.n").cast("long"), F.col("__m.lines.n").cast("long")
    new = {
        "n_words": n,
        "word_chars": F.col("__m.word_chars"),
        "n_symbols": F.col("__m.n_symbols"),
        "n_dup_lines": F.col("__m.lines.dup").cast("long"),
        "n_repeat_words": F.col("__m.words.rep").cast("long"),
        "mean_word_chars": F.col("__m.word_chars") / F.greatest(n, F.lit(1)),
        "symbol_ratio": F.col("__m.n_symbols") / F.greatest(n, F.lit(1)),
        "stop_ratio": F.col("__m.words.stop") / F.greatest(n, F.lit(1)),
        "dup_line_ratio": F.col("__m.lines.dup") / F.greatest(lines, F.lit(1)),
    }
    out = beside(ready, new).drop("__m")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return beside(out, {"base_failed": failed, "kept": ~failed & verdict(rules)})


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return quality_rules(docs).select("doc_id", *COLUMNS)


def _sql() -> str:
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT k, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT k, i, ws[i:i+4] AS win FROM (SELECT k, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
r AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, win) AS c FROM g) WHERE c > 1),
v AS (SELECT k, sum(least(5, i - prev)) AS n FROM (SELECT k, i, coalesce(lag(i) OVER (PARTITION BY k ORDER BY i), -9) AS prev FROM r) GROUP BY k),
m AS (SELECT doc_id, len(ws) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, len(ls) AS n_lines,
        coalesce(v.n, 0) AS n_repeat_words,
        len(list_filter(ws, lambda x: lower(regexp_replace(x, '[^\p{{L}}]+', '', 'g')) IN ({stops}))) AS n_stop
      FROM w LEFT JOIN v USING (k)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, greatest(n_words, 1) AS n1 FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND word_chars / n1 BETWEEN 2 AND 12 AND n_symbols / n1 <= 0.1
    AND (n_words < 50 OR n_stop / n1 >= 0.02) AND n_dup_lines / greatest(n_lines, 1) <= 0.6 AS kept
FROM f"""


QUERIES = {"op6_quality_rules": op6_quality_rules}
SQL = {"op6_quality_rules": _sql()}
