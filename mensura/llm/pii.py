"""Personal data by weak supervision, in DataFrame functions only.

Base spans are those of fixed patterns (e-mail, IP, card, phone). Beyond them, wide patterns propose candidates, and three
labelers vote on each: a strict pattern of the kind, a gazetteer of words in or beside the span, and cue words in the
context before it; each says yes, no or nothing. Expectation-maximisation over the counts of vote patterns estimates how
reliable each labeler is and how likely each pattern marks personal data; with these as soft labels, a naive Bayes
classifier over span features and votes is trained, and its verdict decides which candidates are spans.

One scan of the texts writes the spans and candidates, without the texts. From that table the cells (votes and features of a
candidate; their number is bounded by the labelers and features, not by the data) are counted over all documents; they are
all the driver sees. Then one projection of the table has the classifier's weights as literals. Nothing moves a text, so no
key can be hot.

Patterns are written so that Java matches them in linear time (possessive loops, and starts only where a run begins), with
no bound on what a format leaves open. Positions are running sums over the pieces between matches, and overlaps are found
from running extremes over all spans in order; both run in chunks, so a text of many matches costs little more than its
length. Defined results: null and empty texts have no span; repeated rows are read each; texts are read whole; extra columns
are ignored; where there are no candidates, base spans alone are returned.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, text_of

#: The contract's patterns: what they match is what the plain forms match, from left to right.
BASE = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", r"@"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]"),
    "card": (r"(?:\G|(?<![0-9]))[0-9](?:[\x20-]?[0-9])++", r"[0-9]"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
}
#: Lengths of bank account numbers by country.
IBAN_LENGTHS = {
    "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IS": 26,
    "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SI": 19, "SK": 24,
}
#: The gazetteers, a parameter of pii_spans: given names, area codes that any number may have, how known services begin their
#: secrets, ends of mail hosts, countries of accounts, and area numbers that were ever given out.
GAZETTEERS = {
    "name": (
        "Adam Albert Alejandro Alexander Alice Ana Andrea Andreas Andrew Angela Anna Anne Antoine Antonio Barbara Benjamin Bernd Birgit Brian Camille Carlos Carmen Caroline Catherine Charles Charlotte Christian Christine "
        "Claire Claudia Daniel David Diego Dominique Edward Elena Elizabeth Emily Emma Eric Eva Felix Fernando Florian Francesca Francisco François Frank Gabriel George Gerhard Hans Heike Helen Helmut Henri Henry "
        "Ingrid Isabel Jack Jacques James Jan Jane Javier Jean Jennifer Jessica Joachim John Jonas Jorge José Joseph Juan Julia Julien Jürgen Karen Karin Karl Katharina Kevin Klaus Laura Léa Leon Linda Lisa Louis Louise "
        "Lucas Lucía Luis Luise Manuel Margaret Maria María Marie Mark Markus Martha Martin Mary Mathilde Matthew Michael Michel Miguel Monika Nicolas Nicole Nina Olivia Pablo Patricia Patrick Paul Paula Pedro Peter "
        "Petra Philippe Pierre Rachel Ralf Richard Robert Rosa Sabine Sarah Sébastien Sofía Sophie Stefan Steven Susan Sylvie Thomas Ursula Uwe Vincent Werner William Wolfgang Yves"
    ).split(),
    "phone": "202 206 212 213 214 215 216 301 303 305 310 312 313 314 323 404 408 410 412 414 415 416 469 503 504 510 512 514 516 571 602 604 612 613 617 619 646 650 702 703 713 714 716 718 773 800 804 813 818 832 844 847 855 858 866 877 888 905 914 916 917 919 949 972".split(),
    "secret": "ghp_ gho_ ghu_ ghs_ ghr_ github_pat_ glpat- sk- sk_ pk_ rk_ xoxa- xoxb- xoxp- xoxr- xoxs- AKIA ASIA AIza eyJ npm_ hf_ pypi- SG. ya29. dop_v1_ shpat_".split(),
    "email": "com org net edu gov info io dev de fr es it uk eu ch at".split(),
    "iban": tuple(IBAN_LENGTHS),
}
_WORD = r"\p{Lu}(?:[\p{L}\p{M}]++|(?=['’]\p{Lu}))(?:-[\p{L}\p{M}]++|['’]\p{Lu}[\p{L}\p{M}]++)*+"
_TITLE = r"(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sra|Sr)\.?\x20"
_PARTICLE = r"(?:(?:von|van|de|der|den|del|du|la|le|di|da|dos|zu|ter)\x20)*+"
_KEY = r"(?<![A-Za-z0-9])(?i:token|password|passwd|secret|api[_-]?key|access[_-]?key)\x20?[=:]\x20?"


def _any(words) -> str:
    return "|".join(re.escape(w) for w in words)


def wide(gazetteers: dict | None = None) -> dict[str, tuple[str, str, str, str, str]]:
    """Kinds beyond the base: pattern, quick test, strict pattern of the value, gazetteer of the value, cues before it. A secret goes to
    white space or its closing quote, a name to its last capitalised word."""
    g = GAZETTEERS | (gazetteers or {})
    return {
        "email": (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[(\[](?i:at)[)\]]\x20?[A-Za-z0-9-]++(?:\.[A-Za-z]{2,}+)++", r"(?i)[(\[]at[)\]]", r"\.[A-Za-z]{2,6}$", rf"(?i)\.(?:{_any(g['email'])})$", r"(?i)\b(?:e-?mail|mail|contact|write|kontakt|correo|courriel)\b"),
        "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2}", r"^[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}", rf"^(?:{_any(g['iban'])})", r"(?i)\b(?:iban|account|konto|compte|cuenta|bank)\b"),
        "name": (rf"(?<!\p{{L}}){_TITLE}{_WORD}(?:\x20{_PARTICLE}{_WORD})*+", rf"{_TITLE}\p{{Lu}}", r"\.\x20\p{Lu}[\p{L}\p{M}'’-]+\x20(?:[\p{L}\p{M}'’-]+\x20)*\p{Lu}[\p{L}\p{M}'’-]+$", rf"(?<!\p{{L}})(?:{_any(g['name'])})(?!\p{{L}})", r"(?i)\b(?:name|dear|signed|by|contact|patient|customer)\b"),
        "phone": (r"(?<![0-9+().-])(?:\([0-9]{3}\)|[0-9]{3})[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])", r"[0-9]{3}[\x20.-][0-9]{4}", r"^(?:\([2-9][0-9]{2}\)\x20|[2-9][0-9]{2}-)[0-9]{3}-[0-9]{4}$", rf"^\(?(?:{_any(g['phone'])})[)\x20.-]", r"(?i)\b(?:phone|tel|call|mobile|cell|fax|telefon|llame|appelez)\b"),
        "secret": (_KEY + r"(?:\"[^\"\x20\x09-\x0D]{12,}+\"?|'[^'\x20\x09-\x0D]{12,}+'?|[^\"'\x20\x09-\x0D]{12,}+)", r"(?i)(?:token|pass|secret|key)", r"[=:]\x20?[\"']?(?=[^\"']*[0-9])(?=[^\"']*[A-Za-z])[^\"'\x20\x09-\x0D]{16,}[\"']?$", rf"[=:]\x20?[\"']?(?:{_any(g['secret'])}|[0-9a-fA-F]{{32}})", r"(?i)\b(?:export|config|env|auth|login|credentials)\b"),
        "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])", r"[0-9]-[0-9]{2}-[0-9]", r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$", r"^(?:[0-6]|7[0-6]|77[0-2])", r"(?i)\b(?:ssn|social|security|insurance|versicherung)\b"),
    }


WIDE = wide()
AGAINST = r"(?i)\b(?:version|page|isbn|figure|table|order|article|chapter)\b"
CONTEXT = 40  # characters before a span
KINDS = (*BASE, *sorted(k for k in WIDE if k not in BASE))
CHUNK = 64  # elements that a running total takes up at once
PIECE = 1024  # characters in which a text is cut up for contexts
LABELERS = ("regex", "gazetteer", "context")
ROUNDS = 50


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, step) -> Column:
    """step over all values up to each, for an array of ints: within chunks, then with what the chunks before come to."""
    grow = lambda a, x: F.concat(a, F.array(F.coalesce(step(F.try_element_at(a, F.lit(-1)), x), x)))
    none = F.array().cast("array<int>")

    def chunks(v: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / CHUNK).cast("int"))
        return F.transform(starts, lambda c: F.aggregate(F.slice(v, c * CHUNK + 1, F.lit(CHUNK)), none, grow))

    def whole(parts: Column) -> Column:
        ends = F.aggregate(F.transform(parts, lambda p: F.element_at(p, -1)), none, grow)
        return _let(ends, lambda e: F.flatten(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.transform(p, lambda x: step(F.element_at(e, i), x))))))

    return _let(values, lambda v: F.when(F.size(v) > 0, _let(chunks(v), whole)).otherwise(none))


def matches(text: Column, pattern: str, quick: str) -> Column:
    """The matches of a pattern from left to right: array of (start, stop, value), in code points."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(h: Column) -> Column:
        steps = F.transform(F.split(text, pattern, -1), lambda p: F.length(p))
        ends = _let(steps, lambda gaps: running(F.transform(h, lambda x, i: F.get(gaps, i) + F.length(x)), lambda a, x: a + x))
        return _let(ends, lambda e: F.transform(h, lambda x, i: F.struct((F.get(e, i) - F.length(x)).alias("start"), F.get(e, i).alias("stop"), x.alias("value"))))

    none = F.array().cast("array<struct<start:int,stop:int,value:string>>")
    return F.when(text.rlike(quick), _let(hits, lambda h: F.when(F.size(h) > 0, placed(h)).otherwise(none))).otherwise(none)


def apart(spans: Column, base: Column) -> Column:
    """The spans (kind, start, stop, value) that overlap none of base (start, stop, ...).

    In order of starts, a span overlaps one that begins no later if the furthest stop so far lies beyond its start, and one
    that begins later if the next start lies before its stop.
    """
    none = F.lit(None)
    flat = lambda s, own: F.struct(s["start"].alias("start"), F.lit(own).alias("own"), s["stop"].alias("stop"), *((s[c] if own else none.cast(t)).alias(c) for c, t in (("kind", "int"), ("value", "string"))))
    ordered = F.sort_array(F.concat(F.transform(base, lambda s: flat(s, False)), F.transform(spans, lambda s: flat(s, True))))

    def whole(e: Column) -> Column:
        furthest = running(F.transform(e, lambda x: F.when(x["own"], F.lit(-1)).otherwise(x["stop"])), lambda a, x: F.greatest(a, x))
        following = F.reverse(running(F.reverse(F.transform(e, lambda x: F.when(x["own"], F.lit(2**31 - 1)).otherwise(x["start"]))), lambda a, x: F.least(a, x)))
        both = F.struct(furthest.alias("upto"), following.alias("from"))
        free = lambda b: F.filter(e, lambda x, i: x["own"] & (F.get(b["upto"], i) <= x["start"]) & (F.get(b["from"], i) >= x["stop"]))
        return F.transform(_let(both, free), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["stop"].alias("stop"), x["value"].alias("value")))

    return F.when((F.size(spans) == 0) | (F.size(base) == 0), spans).otherwise(_let(ordered, whole))


def _luhn(digits: Column) -> Column:
    each = F.transform(F.regexp_extract_all(F.reverse(digits), F.lit("[0-9]"), F.lit(0)), lambda d, i: _let(d.cast("int") * F.when(i % 2 == 1, 2).otherwise(1), lambda v: F.when(v > 9, v - 9).otherwise(v)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(digits)
    if kind == "ip":
        part = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2}|)"
        return value.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.when(n.between(13, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def _iban(value: Column) -> Column:
    """Whether an account number has its country's length and a remainder of 1 by 97."""
    bare = F.replace(value, F.lit(" "), F.lit(""))
    lengths = F.create_map(*(F.lit(x) for pair in IBAN_LENGTHS.items() for x in pair))
    signs = F.regexp_extract_all(F.concat(F.substring(bare, 5, 64), F.substring(bare, 1, 4)), F.lit("."), F.lit(0))
    rest = F.aggregate(signs, F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), a * 10 + c.try_cast("int")).otherwise(a * 100 + F.ascii(c) - 55) % 97)
    return (F.try_element_at(lengths, F.substring(bare, 1, 2)) == F.length(bare)) & (rest == 1)


def base_spans(text: Column) -> dict[str, Column]:
    """kind -> its spans that pass, each (start, stop, value)."""
    passing = lambda kind: lambda m: _valid(kind, m["value"])
    return {k: F.filter(matches(text, *p), passing(k)) for k, p in BASE.items()}


def candidates(text: Column, base: Column, rules: dict | None = None) -> Column:
    """Candidates of all wide patterns that overlap no base span: (kind, start, stop, votes, features)."""
    rules = WIDE if rules is None else rules
    names = list(rules)
    labelled = lambda i: lambda m: F.struct(F.lit(i).alias("kind"), m["start"].alias("start"), m["stop"].alias("stop"), m["value"].alias("value"))
    wide = F.concat(*(F.transform(matches(text, *rules[k][:2]), labelled(i)) for i, k in enumerate(names)))

    def of_kind(m: Column, make) -> Column:
        out = F.when(m["kind"] == 0, make(names[0], *rules[names[0]][2:]))
        for i, k in enumerate(names[1:], 1):
            out = out.when(m["kind"] == i, make(k, *rules[k][2:]))
        return out

    def voted(m: Column, pieces: Column) -> Column:
        # of the two pieces of text up to where the span begins: to count from the text's start for each would be quadratic
        at = F.floor(m["start"] / PIECE).cast("int")
        near = F.concat(F.coalesce(F.get(pieces, at - 1), F.lit("")), F.get(pieces, at))
        begin = m["start"] - F.greatest(at - 1, F.lit(0)) * PIECE
        before = F.substring(near, F.greatest(begin - CONTEXT + 1, F.lit(1)), F.least(begin, F.lit(CONTEXT)))
        yes = lambda c: F.when(c, F.lit("y"))

        def whole(ctx: Column) -> Column:
            value = m["value"]
            votes = of_kind(
                m,
                lambda k, strict, gazetteer, cues: F.concat(
                    yes(value.rlike(strict) & F.coalesce(_iban(value), F.lit(False)) if k == "iban" else value.rlike(strict)).otherwise(F.lit("n")), yes(value.rlike(gazetteer)).otherwise(F.lit("-")), yes(ctx.rlike(cues)).when(ctx.rlike(AGAINST), F.lit("n")).otherwise(F.lit("-"))
                ),
            )
            kind = F.element_at(F.array(*map(F.lit, names)), m["kind"] + 1)
            digits = F.floor(4 * F.length(F.regexp_replace(value, "[^0-9]", "")) / F.length(value)).cast("string")
            edge = lambda c: F.when(c.rlike("[A-Za-z0-9]"), "w").when(c.rlike(r"[#$%&*]"), "s").otherwise("o")
            features = F.array(
                F.concat(F.lit("kind="), kind),
                F.concat(kind, F.lit(" length="), F.least(F.lit(4), F.floor(F.length(value) / 8)).cast("string")),
                F.concat(kind, F.lit(" digits="), digits),
                F.concat(F.lit("before="), edge(F.substring(ctx, -1, 1))),
            )
            return F.struct(kind.alias("kind"), m["start"].alias("start"), m["stop"].alias("stop"), votes.alias("votes"), features.alias("features"))

        return _let(before, whole)

    def all_voted(w: Column) -> Column:
        pieces = F.when(F.size(w) > 0, F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)))
        return _let(pieces, lambda p: F.transform(apart(w, base), lambda m: voted(m, p)))

    return _let(wide, all_voted)


def found(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", gazetteers: dict | None = None) -> DataFrame:
    """(doc_id, email, ip, card, phone, extra): base spans by kind, each (start, stop), and the candidates."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), text_of(text).alias("text"))
    bare = lambda spans: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop")))
    rows = rows.select("doc_id", "text", *(bare(v).alias(k) for k, v in base_spans(F.col("text")).items()))
    base = F.concat(*(F.col(k) for k in BASE))
    return rows.select("doc_id", *BASE, candidates(F.col("text"), base, wide(gazetteers)).alias("extra"))


def cells_of(rows: DataFrame) -> DataFrame:
    """How often each combination of votes and features occurs among the candidates."""
    one = rows.where(F.size("extra") > 0).select(F.explode("extra").alias("c"))
    return one.groupBy(F.col("c.votes").alias("votes"), F.col("c.features").alias("features")).agg(F.count(F.lit(1)).alias("n"))


def reliabilities(counts: dict[str, float], rounds: int = ROUNDS) -> tuple[dict[str, float], list[dict[str, tuple[float, float]]]]:
    """EM over vote patterns: the chance that a pattern marks personal data, and each labeler's (P(vote | yes), P(vote | no))."""
    said = {"y": (0.7, 0.2), "n": (0.1, 0.5), "-": (0.2, 0.3)}
    tables, prior, post = [dict(said) for _ in LABELERS], 0.5, {}
    for _ in range(rounds):
        for votes in counts:
            yes, no = prior, 1 - prior
            for t, v in zip(tables, votes, strict=True):
                yes, no = yes * t[v][0], no * t[v][1]
            post[votes] = yes / (yes + no)
        total, sure = sum(counts.values()), sum(n * post[v] for v, n in counts.items())
        prior = (sure + 1) / (total + 2)
        for i, t in enumerate(tables):
            for v in said:
                own = [(n, post[k]) for k, n in counts.items() if k[i] == v]
                # priors of weight 5 hold a labeler to its bent where votes are few
                t[v] = (5 * said[v][0] + sum(n * p for n, p in own)) / (5 + sure), (5 * said[v][1] + sum(n * (1 - p) for n, p in own)) / (5 + total - sure)
    return post, tables


def classifier(cells: list[tuple[str, list[str], int]]) -> dict[str, float]:
    """Naive Bayes weights, by feature and by vote, from cells labelled by EM; "" is the bias."""
    counts: dict[str, float] = defaultdict(float)
    for votes, _, n in cells:
        counts[votes] += n
    post, _ = reliabilities(counts)
    yes, no = 1.0, 1.0
    by: dict[str, list[float]] = defaultdict(lambda: [0.0, 0.0])
    for votes, features, n in cells:
        p = post[votes]
        yes, no = yes + n * p, no + n * (1 - p)
        for f in (*features, *(f"{a}={v}" for a, v in zip(LABELERS, votes, strict=True))):
            by[f][0] += n * p
            by[f][1] += n * (1 - p)
    return {"": math.log(yes / no)} | {f: math.log((a + 1) / (yes + 2)) - math.log((b + 1) / (no + 2)) for f, (a, b) in by.items()}


def _score(c: Column, weights: dict[str, float]) -> Column:
    table = F.create_map(*(F.lit(x) for pair in weights.items() for x in pair))
    names = F.concat(c["features"], *(F.array(F.concat(F.lit(f"{a}="), F.substring(c["votes"], i, 1))) for i, a in enumerate(LABELERS, 1)))
    return F.aggregate(names, F.lit(weights[""]), lambda a, f: a + F.coalesce(F.try_element_at(table, f), F.lit(0.0)))


def pii_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", gazetteers: dict | None = None) -> DataFrame:
    """One row per row of docs: doc_id, a count per base kind, base and all spans (arrays of kind, start, stop, by kind and start).
    gazetteers: lists by kind in place of those of GAZETTEERS; they stand in patterns, so they should be of some thousand words at most."""
    rows = cut(found(docs, doc_id, text, gazetteers), "spans")
    cells = [(r["votes"], list(r["features"]), r["n"]) for r in cells_of(rows).collect()]  # as many as labelers and features allow
    weights = classifier(cells)
    named = lambda spans, kind: F.transform(spans, lambda s: F.struct(F.lit(KINDS.index(kind)).alias("order"), s["start"].alias("start"), s["stop"].alias("stop")))
    base = F.concat(*(named(F.col(k), k) for k in BASE))
    if cells:
        orders = F.create_map(*(F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)))
        extra = F.transform(F.filter("extra", lambda c: _score(c, weights) > 0), lambda c: F.struct(F.element_at(orders, c["kind"]).alias("order"), c["start"].alias("start"), c["stop"].alias("stop")))
    else:
        extra = F.array().cast("array<struct<order:int,start:int,stop:int>>")
    return rows.select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in BASE), F.sort_array(base).alias("base"), F.sort_array(F.concat(base, extra)).alias("spans"))


def joined(spans: str) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["order"] + 1), s["start"], s["stop"])), ",")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pii_spans(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return rows.select("doc_id", *(f"n_{k}" for k in BASE), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


QUERIES = {"op7_pii": op7_pii}
SQL: dict[str, str] = {}
