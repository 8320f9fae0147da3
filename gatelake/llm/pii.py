"""Personal data by weak supervision, in DataFrame operations on the executors.

Regular expressions give candidate spans. Four labelers (pattern, gazetteer, context, surroundings) vote on each: for,
against, or not at all. Expectation-maximisation over the counted vote combinations estimates how reliable each labeler
is for each kind; the posteriors are the soft labels of a logistic span classifier over the votes. The combinations are
at most len(KINDS) * 3**4, so this fits the driver whatever the input is. Spans of the base kinds that pass their rule
always stay; the classifier decides about the other kinds, outside base spans.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatelake.llm.common import shared_table

#: Kinds in the order of the output: the four base kinds, then those the method adds.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "local_phone", "secret", "ssn")
LABELERS = ("pattern", "gazetteer", "context", "around")

# Patterns are possessive where giving back characters could not help: same matches, no backtracking, no recursion.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])",
    "local_phone": r"(?<![0-9A-Za-z+.-])(?:\([0-9]{3}\)\x20|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9A-Za-z-])",
    "secret": r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,72}|(?:password|passwd|token|secret|api_key)\x20?[=:]\x20?\"?[A-Za-z0-9_+/-]{8,128})",
    "ssn": r"(?<![0-9A-Za-z.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
}
#: A text without this cannot hold the kind; a plain search that is cheaper than the pattern.
NEEDS = {"email": "@", "phone": "+", "secret": None, "iban": None}
OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})){3}$"
GAZETTEERS = {
    "email": r"(?i)\.(?:com|org|net|edu|gov|io|info|biz|eu|de|fr|es|it|uk|us|ch|at|nl|be)$",
    "ip": r"^(?!0|127\.|2(?:2[4-9]|[3-5][0-9])\.)",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))",
    "phone": r"^\+(?:1|7|2[07]|3[0-469]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])",
    "iban": r"^(?:AT|BE|CH|DE|DK|ES|FI|FR|GB|IE|IT|LU|NL|NO|PL|PT|SE)",
    "local_phone": r"^\(?[2-9]",
    "secret": r"^(?:AKIA|gh[pousr]_|xox)|[=:]\x20?\"?(?=[A-Za-z_+/-]*[0-9])",
    "ssn": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)",
}
CONTEXTS = {
    "email": r"(?i)mail|contact|write|kontakt|correo|courriel",
    "ip": r"(?i)\bip\b|address|host|server|login|adresse",
    "card": r"(?i)card|visa|master|credit|karte|carte|tarjeta",
    "phone": r"(?i)tel|phone|call|fax|mobile|mobil",
    "iban": r"(?i)iban|account|konto|compte|cuenta|bank",
    "local_phone": r"(?i)tel|phone|call|fax|mobile",
    "secret": r"(?i)key|secret|token|password|aws|credential",
    "ssn": r"(?i)ssn|social|security",
}
AGAINST = r"(?i)version|chapter|section|isbn|figure|invoice|order\x20"
#: Characters before a span that the context labeler reads.
WINDOW = 32
EM_STEPS = 50


def found(text: Column, kind: str) -> Column:
    """Matches of a kind's pattern in one text, leftmost and without overlap."""
    hits = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    need = NEEDS.get(kind, "digit")
    if need is None:
        has = F.lit(True) if kind == "secret" else F.col("has_digit")  # a password may have no digit, an iban has two
    else:
        has = F.col("has_digit") if need == "digit" else F.contains(text, F.lit(need))
    return F.when(has, hits).otherwise(F.array().cast("array<string>"))


def _located(text: Column, hits: Column, kind: str) -> Column:
    """start, end (code points, end exclusive) and the match; starts are sums over what lies between the matches."""
    gaps = F.transform(F.split(text, PATTERNS[kind], -1), F.length)
    total = lambda a, n: F.aggregate(F.slice(a, 1, n), F.lit(0), lambda x, y: x + y)
    spans = F.transform(hits, lambda m, i: F.struct((total(gaps, i + 1) + total(F.transform(hits, F.length), i)).alias("start"), m.alias("match")))
    spans = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (s["start"] + F.length(s["match"])).alias("end"), s["match"].alias("match")))
    none = F.array().cast("array<struct<start:int,end:int,match:string>>")
    return F.when(F.size(hits) > 0, spans).otherwise(none)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(d: Column) -> Column:
    digit = lambda i: F.substring(d, F.length(d) - i + 1, F.lit(1)).cast("int")
    twice = lambda i: F.when(digit(i) > 4, 2 * digit(i) - 9).otherwise(2 * digit(i))
    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda s, i: s + F.when(i % 2 == 0, twice(i)).otherwise(digit(i))) % 10 == 0


def valid(m: Column, kind: str) -> Column:
    """Whether a match obeys its kind's rule beyond the pattern."""
    d = _digits(m)
    if kind == "ip":
        return m.rlike(OCTETS)
    if kind == "card":
        return F.when(F.length(d).between(16, 19), _luhn(d)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(d).between(8, 15)
    return F.lit(True)


def _voted(text: Column, spans: Column, kind: str) -> Column:
    """Each span with its votes: 1 for, 2 against, 0 none, in the order of LABELERS."""

    def votes(s: Column) -> Column:
        before = F.substring(text, F.greatest(s["start"] - WINDOW + 1, F.lit(1)), F.least(s["start"], F.lit(WINDOW)))
        sides = F.concat(F.substring(text, F.greatest(s["start"], F.lit(1)), F.least(s["start"], F.lit(1))), F.lit(" "), F.substring(text, s["end"] + 1, F.lit(1)))
        return F.struct(
            F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["match"].alias("match"),
            F.when(valid(s["match"], kind), 1).otherwise(2).alias("pattern"),
            F.when(s["match"].rlike(GAZETTEERS[kind]), 1).otherwise(2).alias("gazetteer"),
            F.when(before.rlike(CONTEXTS[kind]), 1).when(before.rlike(AGAINST), 2).otherwise(0).alias("context"),
            F.when(sides.rlike(r"[\p{L}\p{N}]"), 2).otherwise(1).alias("around"),
        )

    return F.transform(spans, votes)


def candidates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id and ``spans``, all candidates with their votes, for each row of ``docs``; the texts are read once."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("has_digit", F.col("text").rlike("[0-9]"))
    text = F.col("text")
    rows = rows.withColumns({f"hits_{k}": found(text, k) for k in KINDS})
    rows = rows.withColumns({f"at_{k}": _located(text, F.col(f"hits_{k}"), k) for k in KINDS})
    return rows.select("doc_id", F.concat(*[_voted(text, F.col(f"at_{k}"), k) for k in KINDS]).alias("spans"))


def estimate(votes: np.ndarray, kinds: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors of the vote combinations, and each kind's labelers' reliabilities (share of votes that agree with the truth).

    Two-coin expectation-maximisation, one prior for each kind, from a start where labelers are right four times in five.
    """
    posterior, reliable = np.full(len(votes), 0.5), np.full((len(KINDS), len(LABELERS)), 0.8)
    for kind in set(kinds.tolist()):
        own = kinds == kind
        v, n = votes[own], counts[own].astype(float)
        prior, hit, miss = 0.7, np.full(v.shape[1], 0.8), np.full(v.shape[1], 0.2)
        for _ in range(EM_STEPS):
            up = np.log(prior) + np.where(v == 1, np.log(hit), np.where(v == 2, np.log(1 - hit), 0)).sum(axis=1)
            down = np.log(1 - prior) + np.where(v == 1, np.log(miss), np.where(v == 2, np.log(1 - miss), 0)).sum(axis=1)
            p = 1 / (1 + np.exp(np.clip(down - up, -50, 50)))
            # Beta priors that say a labeler is right more often than not keep the two classes from changing places.
            hit = ((n * p)[:, None] * (v == 1)).sum(axis=0) + 8
            hit = hit / (((n * p)[:, None] * (v > 0)).sum(axis=0) + 10)
            miss = ((n * (1 - p))[:, None] * (v == 1)).sum(axis=0) + 2
            miss = miss / (((n * (1 - p))[:, None] * (v > 0)).sum(axis=0) + 10)
            prior = float(np.clip((n * p).sum() / n.sum(), 0.02, 0.98))
        posterior[own] = p
        reliable[kind] = (n[:, None] * ((v == 1) * p[:, None] + (v == 2) * (1 - p)[:, None])).sum(axis=0) / np.maximum((n[:, None] * (v > 0)).sum(axis=0), 1)
    return posterior, reliable


def _design(votes: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    signed = np.where(votes == 1, 1.0, np.where(votes == 2, -1.0, 0.0))
    return np.concatenate([np.eye(len(KINDS))[kinds], signed], axis=1)


def fit_classifier(votes: np.ndarray, kinds: np.ndarray, counts: np.ndarray, soft: np.ndarray) -> np.ndarray:
    """Weights of a logistic classifier (an intercept for each kind, a weight for each labeler) on soft labels."""
    x, n = _design(votes, kinds), np.log1p(counts)
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w)), x.T @ (n * (soft - p)) - 0.1 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def detect(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base (spans of the base kinds that pass their rule) and spans (base and what the classifier adds) per row.

    A span has kind, start, end (code points, end exclusive), match and probability; both arrays are ordered by kind, in
    the order of KINDS, and start. A null or empty text has none. Repeated rows give repeated results, other columns are
    not read, an empty table gives an empty result.
    """
    kept = shared_table(candidates(docs, id_col, text_col), "pii")
    combos = kept.select(F.explode("spans").alias("s")).groupBy("s.kind", *[f"s.{x}" for x in LABELERS]).count().collect()
    combos.sort()
    kinds = np.array([KINDS.index(r["kind"]) for r in combos], dtype=np.int64)
    votes = np.array([[r[x] for x in LABELERS] for r in combos], dtype=np.int64).reshape(-1, len(LABELERS))
    counts = np.array([r["count"] for r in combos], dtype=np.int64)
    weights = np.zeros(len(KINDS) + len(LABELERS))
    if len(combos):
        soft, _ = estimate(votes, kinds, counts)
        weights = fit_classifier(votes, kinds, counts, soft)

    def probability(s: Column) -> Column:
        z = F.element_at(F.array(*[F.lit(float(x)) for x in weights[: len(KINDS)]]), F.array_position(F.array(*[F.lit(k) for k in KINDS]), s["kind"]).cast("int"))
        for name, w in zip(LABELERS, weights[len(KINDS) :]):
            z = z + F.when(s[name] == 1, float(w)).when(s[name] == 2, float(-w)).otherwise(0.0)
        return 1 / (1 + F.exp(-z))

    fields = lambda s: F.struct(*[s[c].alias(c) for c in ("kind", "start", "end", "match")], probability(s).alias("probability"))
    is_base = lambda s: s["kind"].isin(*BASE_KINDS)
    base = F.transform(F.filter("spans", lambda s: is_base(s) & (s["pattern"] == 1)), fields)
    within = lambda s: F.exists("base", lambda b: (b["start"] <= s["start"]) & (s["end"] <= b["end"]))
    added = F.filter(F.transform(F.filter("spans", lambda s: ~is_base(s)), fields), lambda s: (s["probability"] >= 0.5) & ~within(s))
    return kept.withColumn("base", base).select("doc_id", "base", F.concat("base", added).alias("spans"))
