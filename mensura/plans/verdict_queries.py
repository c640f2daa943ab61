"""Text-rule verdicts over the electrode view."""

from __future__ import annotations

from pyspark.sql import functions as F

from mensura.functions import rules as R
from mensura.operators import bookkeeping as B
from mensura.plans import fixtures as X


def row_place():
    return B.row_index("source_file", "electrode_id")


def judged(spark, d):
    return R.apply_rules(X.electrodes(spark, d))


def indexed(spark, d):
    return judged(spark, d).withColumn("row_index", row_place())


def verdict_counts(spark, d):
    return R.verdict_counts(judged(spark, d))


def verdict_rows(spark, d):
    return judged(spark, d).select("electrode_id", "formula_match", "synthesis_match", "electrolyte_match", "overall")


def reasoning_rows(spark, d):
    return R.reasoning_table(indexed(spark, d), ["source_file", "row_index"])


def verdict_titles(spark, d):
    """The rules over columns named as in the raw files."""
    names = {"formula": ("Mxene formula", "mxene_formula"), "synthesis": ("Synthesis method", "synthesis_method"), "electrolyte": ("Electrolyte", "electrolyte")}
    raw = X.electrodes(spark, d).select("electrode_id", *(F.col(c).alias(title) for title, c in names.values()))
    return R.apply_rules(raw, {k: title for k, (title, _) in names.items()}).select("electrode_id", "formula_match", "synthesis_match", "electrolyte_match", "overall")


def scrubbed_exact(spark, d):
    """Whole cells that say nothing are emptied too."""
    return R.scrub_placeholders(X.electrodes(spark, d), ["synthesis_method"], exact=("hcl wash", "unspecified")).select("electrode_id", "synthesis_method")


def synthesis_reasons(spark, d):
    """The second version's sentences."""
    return R.scrub_placeholders(X.electrodes(spark, d), ["synthesis_method"]).select("electrode_id", R.synthesis_reason(F.col("synthesis_method"), "one").alias("reason"))


def row_index(spark, d):
    return indexed(spark, d).select("source_file", "electrode_id", "row_index")


def passed_preview(spark, d):
    rows = R.split_by_verdict(judged(spark, d))["PASS"]
    return rows.select("source_file", "electrode_id", "mxene_formula", "electrolyte", "interlayer_spacing")


def rejoin_source(spark, d):
    """Outputs joined back to their source rows by (file, row index)."""
    out = indexed(spark, d).select("source_file", "row_index", "overall")
    src = X.electrodes(spark, d).select("source_file", "electrode_id", row_place().alias("row_index"))
    return src.join(out, ["source_file", "row_index"]).select("electrode_id", "overall")


def scrubbed(spark, d):
    cols = ["mxene_formula", "synthesis_method", "electrolyte"]
    return R.scrub_placeholders(X.electrodes(spark, d), cols).select("electrode_id", *cols)


def primary_terms(spark, d):
    return X.electrodes(spark, d).select("electrode_id", R.primary_term(R.normalise_text(F.col("mxene_formula"))).alias("term"))


def sulfuric_fixed(spark, d):
    """The electrolyte rule with the preset that knows both spellings."""
    return R.verdict_counts(R.apply_rules(X.electrodes(spark, d), preset="fixed"))


def normalised_nfkc(spark, d):
    return X.electrodes(spark, d).select("electrode_id", R.normalise_text_full(F.coalesce("mxene_formula", F.lit(""))).alias("text"))


QUERIES = {f.__name__: f for f in (verdict_counts, verdict_rows, reasoning_rows, row_index, verdict_titles, scrubbed_exact, synthesis_reasons, passed_preview, rejoin_source, scrubbed, primary_terms, sulfuric_fixed, normalised_nfkc)}

_NULLS = R.PLACEHOLDER


def _scrub(c):
    return f"CASE WHEN {c} IS NULL OR regexp_matches({c}, '{_NULLS}') THEN '' ELSE {c} END"


def _judged(sulfuric=r"h2so4|su[lp]phuric[\s\-]?acid"):
    return rf"""
s AS (SELECT source_file, electrode_id, interlayer_spacing, {_scrub('mxene_formula')} AS f, {_scrub('synthesis_method')} AS s, {_scrub('electrolyte')} AS l FROM e),
n AS (SELECT *, lower(translate(f, '₀₁₂₃₄₅₆₇₈₉ₓ', '0123456789x')) AS nf, lower(translate(s, '₀₁₂₃₄₅₆₇₈₉ₓ', '0123456789x')) AS ns, lower(translate(l, '₀₁₂₃₄₅₆₇₈₉ₓ', '0123456789x')) AS nl FROM s),
k AS (SELECT *, CASE WHEN regexp_matches(trim(regexp_split_to_array(nf, ';|/|,|\(secondary\)|\(minor\)|\(second')[1]), 'ti3c2') THEN true WHEN regexp_matches(nf, 'ti3c2') THEN false WHEN trim(nf) = '' THEN NULL ELSE false END AS fm,
  regexp_matches(ns, '\blif\b|lithium[\s\-]?fluoride') AS lif, regexp_matches(ns, '\bhcl\b|hydrochloric[\s\-]?acid') AS hcl,
  CASE WHEN trim(l) = '' THEN NULL ELSE regexp_matches(nl, '{sulfuric}') END AS em FROM n),
j AS (SELECT *, CASE WHEN trim(s) = '' THEN NULL ELSE lif AND hcl END AS sm FROM k),
v AS (SELECT *, CASE WHEN fm IS NULL OR sm IS NULL OR em IS NULL THEN 'AMBIGUOUS' WHEN fm AND sm AND em THEN 'PASS' ELSE 'FAIL' END AS overall,
  row_number() OVER (PARTITION BY source_file ORDER BY electrode_id) - 1 AS row_index FROM j)"""


def _with(body, **k):
    return X.sql("").rstrip() + ", " + _judged(**k).strip() + " " + body


SQL = {
    "verdict_counts": _with("SELECT overall, count(*) AS n FROM v GROUP BY overall"),
    "sulfuric_fixed": _with("SELECT overall, count(*) AS n FROM v GROUP BY overall", sulfuric=r"h2so4|sul(f|ph)uric[\s\-]?acid"),
    "verdict_titles": _with("SELECT electrode_id, fm AS formula_match, sm AS synthesis_match, em AS electrolyte_match, overall FROM v"),
    "scrubbed_exact": _with("SELECT electrode_id, CASE WHEN lower(trim(s)) IN ('hcl wash', 'unspecified') THEN '' ELSE s END AS synthesis_method FROM v"),
    "synthesis_reasons": _with("SELECT electrode_id, CASE WHEN sm IS NULL THEN 'Synthesis is empty.' WHEN sm THEN 'Synthesis explicitly mentions both LiF and HCl.' WHEN NOT lif AND NOT hcl THEN 'Synthesis mentions neither LiF nor HCl.' ELSE 'Synthesis mentions only one of LiF or HCl.' END AS reason FROM v"),
    "verdict_rows": _with("SELECT electrode_id, fm AS formula_match, sm AS synthesis_match, em AS electrolyte_match, overall FROM v"),
    "row_index": _with("SELECT source_file, electrode_id, CAST(row_index AS INT) AS row_index FROM v"),
    "passed_preview": _with("SELECT source_file, electrode_id, f AS mxene_formula, l AS electrolyte, interlayer_spacing FROM v WHERE overall = 'PASS'"),
    "rejoin_source": _with("SELECT electrode_id, overall FROM v"),
    "scrubbed": _with("SELECT electrode_id, f AS mxene_formula, s AS synthesis_method, l AS electrolyte FROM v"),
    "primary_terms": X.sql(r"SELECT electrode_id, trim(regexp_split_to_array(lower(translate(mxene_formula, '₀₁₂₃₄₅₆₇₈₉ₓ', '0123456789x')), ';|/|,|\(secondary\)|\(minor\)|\(second')[1]) AS term FROM e"),
    "normalised_nfkc": X.sql("SELECT electrode_id, lower(translate(coalesce(mxene_formula, ''), '₀₁₂₃₄₅₆₇₈₉ₓ', '0123456789x')) AS text FROM e"),
    "reasoning_rows": _with("""SELECT source_file, CAST(row_index AS INT) AS row_index, fm AS formula_match, sm AS synthesis_match, em AS electrolyte_match, overall,
CASE WHEN fm THEN 'Primary formula ''' || trim(f) || ''' contains Ti₃C₂ (Ti₃C₂Tₓ or Ti₃C₂).' WHEN nf LIKE '%ti3c2%' THEN 'Ti₃C₂ appears in ''' || trim(f) || ''' but is not the primary formula.' WHEN fm IS NULL THEN 'Formula cell is empty.' ELSE 'Primary formula ''' || trim(f) || ''' is not Ti₃C₂Tₓ or Ti₃C₂.' END AS formula_reasoning,
CASE WHEN sm IS NULL THEN 'Synthesis cell is empty.' WHEN sm THEN 'Synthesis explicitly mentions both LiF and HCl.' WHEN NOT lif AND NOT hcl THEN 'Synthesis mentions neither LiF nor HCl.' WHEN NOT lif THEN 'Synthesis mentions HCl but not LiF.' ELSE 'Synthesis mentions LiF but not HCl.' END AS synthesis_reasoning,
CASE WHEN em IS NULL THEN 'Electrolyte cell is empty.' WHEN em THEN 'Electrolyte explicitly mentions H₂SO₄ (sulfuric acid).' ELSE 'Electrolyte ''' || trim(l) || ''' is not H₂SO₄.' END AS electrolyte_reasoning,
CASE WHEN fm AND sm AND em THEN 'Passes all criteria.' ELSE concat_ws(' ', CASE WHEN NOT fm THEN 'Formula does not match.' END, CASE WHEN NOT sm THEN 'Synthesis does not match.' END, CASE WHEN NOT em THEN 'Electrolyte does not match.' END, CASE WHEN fm IS NULL OR sm IS NULL OR em IS NULL THEN 'One or more fields are empty.' END) END AS overall_reasoning FROM v"""),
}
