"""Text rules with a tri-state verdict: true, false, or null where a cell is empty."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SUBSCRIPTS, PLAIN = "₀₁₂₃₄₅₆₇₈₉ₓ", "0123456789x"
#: Cells that say nothing, and the patterns of the three criteria.
PLACEHOLDER = r"(?i)not\s+reported|not\s+available|not\s+specified|not\s+applicable|\bn/a\b|\bna\b|\bnone\b|\bunknown\b|\bunspecified\b"
SPLIT = r";|/|,|\(secondary\)|\(minor\)|\(second"
FORMULA = r"ti3c2"
ELECTROLYTE = {"parity": r"h2so4|su[lp]phuric[\s\-]?acid", "fixed": r"h2so4|sul(f|ph)uric[\s\-]?acid"}
SYNTHESIS = {"LiF": r"\blif\b|lithium[\s\-]?fluoride", "HCl": r"\bhcl\b|hydrochloric[\s\-]?acid"}


def normalise_text(c: Column) -> Column:
    return F.lower(F.translate(c, SUBSCRIPTS, PLAIN))


@F.pandas_udf(T.StringType())
def normalise_text_full(c: pd.Series) -> pd.Series:
    """NFKC, which no built-in function offers, by Arrow batches."""
    return c.str.normalize("NFKC").str.lower()


def scrub_placeholders(df: DataFrame, cols: Sequence[str], exact: Sequence[str] = ()) -> DataFrame:
    """The given columns in one projection: null and placeholder cells become empty."""
    def scrub(c: Column) -> Column:
        bad = c.isNull() | c.rlike(PLACEHOLDER)
        return F.when(bad | F.lower(F.trim(c)).isin(*exact) if exact else bad, "").otherwise(c)

    return df.select(*(scrub(F.col(c)).alias(c) if c in cols else F.col(c) for c in df.columns))


def primary_term(c: Column, split: str = SPLIT) -> Column:
    return F.trim(F.split(c, split)[0])


def check_primary(c: Column, pattern: str = FORMULA) -> Column:
    norm = normalise_text(c)
    return F.when(primary_term(norm).rlike(pattern), True).when(norm.rlike(pattern), False).when(F.trim(norm) == "", F.lit(None)).otherwise(False)


def check_any(c: Column, pattern: str) -> Column:
    return F.when(F.trim(c) == "", F.lit(None).cast("boolean")).otherwise(normalise_text(c).rlike(pattern))


def check_all(c: Column, patterns: dict[str, str]) -> Column:
    norm = normalise_text(c)
    every = reduce(lambda a, b: a & b, (norm.rlike(p) for p in patterns.values()))
    return F.when(F.trim(c) == "", F.lit(None).cast("boolean")).otherwise(every)


def overall(matches: Sequence[Column]) -> Column:
    """Null beats false: any null is ambiguous."""
    some_null = reduce(lambda a, b: a | b, (m.isNull() for m in matches))
    return F.when(some_null, "AMBIGUOUS").when(reduce(lambda a, b: a & b, matches), "PASS").otherwise("FAIL")


#: Fixed values, here and in the next three: the sentences.
def formula_reason(c: Column) -> Column:
    m, norm, raw = check_primary(c), normalise_text(c), F.trim(c)
    return (
        F.when(m, F.concat(F.lit("Primary formula '"), raw, F.lit("' contains Ti₃C₂ (Ti₃C₂Tₓ or Ti₃C₂).")))
        .when(norm.rlike(FORMULA), F.concat(F.lit("Ti₃C₂ appears in '"), raw, F.lit("' but is not the primary formula.")))
        .when(m.isNull(), "Formula cell is empty.")
        .otherwise(F.concat(F.lit("Primary formula '"), raw, F.lit("' is not Ti₃C₂Tₓ or Ti₃C₂.")))
    )


def synthesis_reason(c: Column, wording: str = "which") -> Column:
    """wording: which says which of the two is missing, one (of the second version) only that one is."""
    norm = normalise_text(c)
    lif, hcl = (norm.rlike(p) for p in SYNTHESIS.values())
    out = (
        F.when(F.trim(c) == "", "Synthesis cell is empty." if wording == "which" else "Synthesis is empty.")
        .when(lif & hcl, "Synthesis explicitly mentions both LiF and HCl.")
        .when(~lif & ~hcl, "Synthesis mentions neither LiF nor HCl.")
    )
    if wording == "one":
        return out.otherwise("Synthesis mentions only one of LiF or HCl.")
    return (
        out
        .when(~lif, "Synthesis mentions HCl but not LiF.")
        .otherwise("Synthesis mentions LiF but not HCl.")
    )


def electrolyte_reason(c: Column, preset: str = "parity") -> Column:
    m = check_any(c, ELECTROLYTE[preset])
    return F.when(m.isNull(), "Electrolyte cell is empty.").when(m, "Electrolyte explicitly mentions H₂SO₄ (sulfuric acid).").otherwise(F.concat(F.lit("Electrolyte '"), F.trim(c), F.lit("' is not H₂SO₄.")))


def overall_reason(formula: Column, synthesis: Column, electrolyte: Column) -> Column:
    some_null = formula.isNull() | synthesis.isNull() | electrolyte.isNull()
    parts = F.concat_ws(
        " ",
        F.when(~formula, "Formula does not match."),
        F.when(~synthesis, "Synthesis does not match."),
        F.when(~electrolyte, "Electrolyte does not match."),
        F.when(some_null, "One or more fields are empty."),
    )
    return F.when(formula & synthesis & electrolyte, "Passes all criteria.").otherwise(parts)


MAPPING = {"formula": "mxene_formula", "synthesis": "synthesis_method", "electrolyte": "electrolyte"}


def apply_rules(df: DataFrame, mapping: dict[str, str] = MAPPING, preset: str = "parity") -> DataFrame:
    """df with the verdict columns beside it; a projection, no join. mapping: criterion -> the source's column."""
    scrubbed = scrub_placeholders(df, list(mapping.values()))
    f, s, e = (F.col(f"`{mapping[k]}`") for k in ("formula", "synthesis", "electrolyte"))
    ready = scrubbed.select("*", check_primary(f).alias("formula_match"), check_all(s, SYNTHESIS).alias("synthesis_match"), check_any(e, ELECTROLYTE[preset]).alias("electrolyte_match"))
    fm, sm, em = F.col("formula_match"), F.col("synthesis_match"), F.col("electrolyte_match")
    return ready.select(
        "*",
        formula_reason(f).alias("formula_reasoning"),
        synthesis_reason(s).alias("synthesis_reasoning"),
        electrolyte_reason(e, preset).alias("electrolyte_reasoning"),
        overall([fm, sm, em]).alias("overall"),
        overall_reason(fm, sm, em).alias("overall_reasoning"),
    )


REASONING = ["formula_match", "formula_reasoning", "synthesis_match", "synthesis_reasoning", "electrolyte_match", "electrolyte_reasoning", "overall", "overall_reasoning"]


def reasoning_table(df: DataFrame, ids: Sequence[str]) -> DataFrame:
    return df.select(*ids, *REASONING)


def verdict_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("overall").agg(F.count(F.lit(1)).alias("n"))


def split_by_verdict(df: DataFrame) -> dict[str, DataFrame]:
    return {v: df.where(F.col("overall") == v) for v in ("PASS", "FAIL", "AMBIGUOUS")}
