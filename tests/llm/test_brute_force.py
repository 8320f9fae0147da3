"""Operators against plain code that tries everything."""

import random
import struct
import time

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from gatelake.llm import exact_dedup, fingerprint, html_text, license_scan, packing, quality
from gatelake.llm.op_packing import vocabulary


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edited(text, n, rng):
    out = list(text)
    for _ in range(n):
        at, how = rng.randrange(len(out)), rng.randrange(3)
        out[at : at + (how != 1)] = [] if how == 0 else [rng.choice("abcdefghi 0123456789")]
    return "".join(out)


def test_licence_spans_end_at_words():
    for text in ("licensed under cc by 4 01234 rest", "gnu general public license version 23456", "xylicensed under cc by 4 0"):
        assert license_scan.scan(text.encode())[2] == [], text


@pytest.mark.parametrize("notice, label, k", [n for n in license_scan.NOTICES if len(n[0]) < 45])
def test_licence_spans_like_all_substrings(notice, label, k):
    rng = random.Random(notice)
    for _ in range(12):
        text = " ".join(["ab cd", edited(notice, rng.randrange(k + 3), rng), rng.choice(["x", "1", "ef gh"])])
        words = text.split()
        near = {(i, j - i): d for i in range(len(words)) for j in range(i + 1, len(words) + 1) if abs(len(" ".join(words[i:j])) - len(notice)) <= k and (d := distance(" ".join(words[i:j]), notice)) <= k}
        spans = license_scan.scan(text.encode(), notices=((notice, label, k),))[2]
        assert bool(spans) == bool(near), text
        for word, n, name, edits, _, found in spans:
            assert name == label and found == " ".join(words[word : word + n]) and near[word, n] <= edits <= k


def test_licence_scan_of_a_long_text_takes_linear_time():
    n, base, spans = license_scan.scan(b"released under the mit license " * 20_000 + b"under the mit" * 50_000)
    assert len(base) == 20_000 and len(spans) == 20_000 and spans[-1][0] == 19_999 * 5


def test_suffix_array_like_sorting():
    rng = np.random.default_rng(1)
    for _ in range(100):
        n = int(rng.integers(1, 60))
        words, page = rng.integers(0, 3, n).astype(np.uint64), np.sort(rng.integers(0, 4, n))
        suffixes = [tuple(words[i : np.searchsorted(page, page[i], side="right")].tolist()) for i in range(n)]
        order, shared = html_text.suffix_array(words, page)
        got = [suffixes[i] for i in order]
        assert got == sorted(got)
        for a, b, k in zip(got, got[1:], shared[1:]):
            assert a[:k] == b[:k] and (k == min(len(a), len(b)) or a[k] != b[k])


def plain_host(pages):
    """Texts of a host's pages (lists of block and zone), by comparing windows of tokens one by one."""
    n = html_text.LENGTH
    streams = [[w for t, _ in p for w in t.split()] for p in pages]
    seen = {}
    for k, s in enumerate(streams):
        for i in range(len(s) - n + 1):
            seen.setdefault(tuple(s[i : i + n]), set()).add(k)
    out = []
    for p, s in zip(pages, streams):
        hit = [len(seen.get(tuple(s[i : i + n]), ())) > 1 for i in range(len(s))]
        covered = [any(hit[max(0, i - n + 1) : i + 1]) for i in range(len(s))]
        lines, at = [], 0
        for text, zone in p:
            words = text.split()
            end = at + len(words)
            cut = [any(hit[j] for j in range(max(at, i - n + 1), i + 1) if j + n <= end) for i in range(at, end)]
            if zone == html_text.CONTENT:
                lines.append(text)
            elif zone == html_text.OPEN and not all(covered[at:end]):
                lines.append(" ".join(w for w, c in zip(words, cut) if not c))
            at = end
        out.append("\n".join(lines))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_host_texts_like_plain_windows(seed, monkeypatch):
    monkeypatch.setattr(html_text, "alike", lambda texts: np.arange(len(texts)))
    rng = np.random.default_rng(seed)
    pool = [" ".join(rng.choice(list("abcdefgh"), size=rng.integers(1, 14))) for _ in range(12)]
    pages = [[(pool[rng.integers(12)] + rng.choice(["", f" {k}x{j}"]), int(rng.integers(3))) for j in range(rng.integers(0, 7))] for k in range(9)]
    assert html_text.host_texts(pages) == plain_host(pages)


def site(n):
    rng = np.random.default_rng(n)
    own = lambda k: " ".join("w%x" % rng.integers(1 << 40) for _ in range(k))
    notice = own(12)
    alone, beside = [own(40) for _ in range(n)], [own(9) for _ in range(n)]
    return [f"<div>{notice}</div><article><p>{a}</p><p>{notice}</p></article><div>{b}</div>" for a, b in zip(alone, beside)], [f"{a}\n{notice}\n{b}" for a, b in zip(alone, beside)], notice


@pytest.mark.parametrize("limit", [5, 1024])
def test_array_decides_blocks_beside_marked_content(spark, monkeypatch, limit):
    monkeypatch.setattr(html_text, "PAGES", limit)
    bodies, want, notice = site(20)
    df = spark.createDataFrame([(k, f"http://a.com/{k}", b) for k, b in enumerate(bodies)], "page_id long, url string, html string")
    texts = lambda: [r["text"] for r in html_text.extract(df).orderBy("page_id").collect()]
    assert texts() == want
    if limit == 1024:  # without the array the notice stays
        assert html_text.host_texts([html_text.blocks(bodies[0])]) == [f"{notice}\n{want[0]}"]


@pytest.mark.parametrize("page", ["<a " * 350_000, '<a "' * 250_000 + ">", "<a \"'>" * 150_000, "<div>" * 100_000 + "</span>" * 80_000, "<script>" + "</script " * 100_000, "<!--" * 250_000, "<" * 1_000_000, "<!" * 500_000 + ">", "<p x='" * 160_000 + "<b>y"], ids=range(9))
def test_broken_markup_takes_linear_time(page):
    began = time.perf_counter()
    html_text.blocks(page)
    assert time.perf_counter() - began < 8


@pytest.mark.parametrize("copies", [0, 3, 400])
@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact_like_dictionaries(spark, copies, keep):
    rng = random.Random(copies)
    texts = [f"text {k} " + "same start " * 9 for k in range(600)] + ["copied"] * copies + [None, ""] * copies + ["a\x00b"] * (copies > 0)
    rng.shuffle(texts)
    ids = rng.sample(range(10**6), len(texts))
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(5)
    groups = {}
    for i, t in zip(ids, texts):
        groups.setdefault(t or "", []).append(i)
    best = {t: (min if keep == "min" else max)(own) for t, own in groups.items()}
    want = sorted((i, best[t or ""], len(groups[t or ""]), i == best[t or ""]) for i, t in zip(ids, texts))
    got = exact_dedup.exact_dedup(df, keep=keep)
    assert sorted(tuple(r) for r in got.select("doc_id", "keep_id", "group_size", "kept").collect()) == want
    assert sorted(r["doc_id"] for r in exact_dedup.kept_rows(df, keep=keep).collect()) == sorted(best.values())


def test_exact_deals_out_only_texts_with_many_rows(spark):
    n = exact_dedup.SPREAD * 4
    df = spark.range(100 * n).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), (F.col("id") % (40 * n)).cast("string"))).alias("text"))
    runs, dealt, names = exact_dedup._sorted_runs(df, "doc_id", "text", "none", "min", [])
    sizes = runs.where(F.col(names["place"]) == 1).groupBy(names["body"]).agg(F.count(F.lit(1)).alias("runs"), F.max(names["run_size"]).alias("most")).collect()
    assert dealt and all((r["runs"] > 1) == (r[0] == "hot") for r in sizes) and max(r["most"] for r in sizes) < 300


def test_token_ids_like_tokenizers_on_random_and_long_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    with open(vocabulary(), "rb") as f:
        coder = packing.encoder(f.read())
    rng = random.Random(5)
    parts = [packing.MARKER, "<|endof", "text|>", " ", "  ", "\n", "\t", "\u00a0", "\u3000", "a", "The", " the", "é", "日本", "😀", "'s", "'S", "1", "²", "_", "$%", "\x00", "\u200d", "ﬁ"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 25))) for _ in range(4000)]
    assert [packing.token_ids(coder, t) for t in texts] == [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]
    for text in ("x" + " " * 1_000_000 + "y", packing.MARKER + "\n " * 600_000 + packing.MARKER, "ab" * 300_000):
        assert packing.token_ids(coder, text) == plain.encode(text, add_special_tokens=False).ids


def test_token_ids_like_tokenizers_on_every_code_point():
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    with open(vocabulary(), "rb") as f:
        coder = packing.encoder(f.read())
    points = [chr(i) for i in range(0x110000) if not 0xD800 <= i <= 0xDFFF]
    for first in range(0, len(points), 2000):
        text = "".join(f"a{c} 1{c}.{c}" for c in points[first : first + 2000])
        assert packing.token_ids(coder, text) == plain.encode(text, add_special_tokens=False).ids, hex(first)


def test_fingerprints_like_sets_of_terms(spark):
    texts = dict(duckdb.sql("SELECT doc_id, coalesce(text, '') FROM '/root/testdata/sf0.001/documents.parquet'").fetchall())
    texts |= {10**12 + 1: "", 10**12 + 2: "same text", 10**12 + 3: "same  TEXT same", 2**60: "only once here", 2**60 + 1: ""}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in fingerprint.fingerprint_documents(df).collect()}
    terms = lambda t: frozenset(t.encode().lower().split())
    ids = sorted(texts)
    count = {}
    for i in ids:
        for w in terms(texts[i]):
            count[w] = count.get(w, 0) + 1
    low, high = (max(fingerprint.MIN_DOCS, b * len(ids)) for b in fingerprint.BAND)
    known = {w for w, n in count.items() if low <= n <= high}
    number = {w: int(fingerprint.distinct_terms(np.frombuffer(w, dtype=np.uint8), np.array([0, len(w)]))[1][0]) for w in count}
    inside = {w: [((h ^ (h >> 31)) * int(d) % (1 << 64)) >> int(s) == 0 for d, s in zip(fingerprint._DRAW, fingerprint._SHIFT)] for w, h in number.items()}

    def subsets(text):
        mine = terms(text) & known or terms(text)
        return [frozenset(w for w in mine if inside[w][k]) for k in range(len(fingerprint._DRAW))] + [mine]

    def near(a, b):
        if a == b:
            return 1.0
        start, best = 0, 0.0
        for _, n in fingerprint.LEVELS:
            pairs = [(x, y) for x, y in zip(a[start : start + n], b[start : start + n]) if x or y]
            best = max([best] + [sum(x == y for x, y in pairs) / max(1, len(pairs))] * (len(pairs) >= 4))
            start += n
        return best

    seen = {}
    for k, i in enumerate(ids):
        text, following = texts[i], texts[ids[(k + 1) % len(ids)]]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        for w in terms(edited) - inside.keys():
            h = int(fingerprint.distinct_terms(np.frombuffer(w, dtype=np.uint8), np.array([0, len(w)]))[1][0])
            inside[w] = [((h ^ (h >> 31)) * int(d) % (1 << 64)) >> int(s) == 0 for d, s in zip(fingerprint._DRAW, fingerprint._SHIFT)]
        own, changed, its = subsets(text), subsets(edited), subsets(following)
        assert (got[i]["n_chars"], got[i]["edited"]) == (len(text), edited)
        assert got[i]["near_edited"] == pytest.approx(near(own, changed)) and got[i]["near_next"] == pytest.approx(near(own, its))
        for parts, sets in ((got[i]["fingerprint"], own), (got[i]["edited_fingerprint"], changed)):
            for n, (part, of) in enumerate(zip(np.frombuffer(parts, dtype=">u4").tolist(), sets)):
                assert (part == 0) == (not of and n < len(sets) - 1)
                assert seen.setdefault((n, of), part) == part
    assert len({(n, p) for (n, _), p in seen.items() if p}) == sum(1 for p in seen.values() if p)


def plain_features(text):
    words = text.split()
    if not words:
        return [0.0] * (len(quality.FEATURES) - 1) + [1.0]
    n, raw = len(words), text.encode()
    low = [w.lower() for w in words]
    symbols = set("%&$#*|<>{}[]\\^~=_@+/`")
    is_upper = lambda w: len(w) > 1 and any("A" <= c <= "Z" for c in w) and not any("a" <= c <= "z" for c in w)
    solid = sum(1 for b in raw if b not in b" \t\n\r\x0b\x0c")
    share = lambda test: sum(1 for b in raw if test(chr(b))) / solid
    mean = lambda test: sum(1 for w in words if test(w)) / n
    punct = ".,;:!?'\"()-"
    lines = [x.split() for x in text.split("\n") if x.split()]
    stats = []
    for x in lines:
        m = len(x)
        stats.append((m, sum(w[-1] in symbols for w in x) / m, sum(map(is_upper, x)) / m, sum(a.lower() == b.lower() for a, b in zip(x, x[1:])) / m))
    worst = lambda k: max([s[k] for s in stats if s[0] >= 8], default=0.0)
    return [
        np.log1p(n), sum(map(len, words)) / n, mean(lambda w: len(w) > 12), share(lambda c: 33 <= ord(c) < 127 and not c.isalnum() and c not in punct), mean(lambda w: bool(symbols & set(w))), mean(lambda w: w[-1] == "!"), mean(lambda w: w == "|"),
        mean(is_upper), share(lambda c: "0" <= c <= "9"), share(lambda c: c in punct), sum(a == b for a, b in zip(low, low[1:])) / n, len(set(low)) / n, len(set(low[:500])) / min(n, 500), max(map(low.count, set(low))) / n,
        1 - len({tuple(w.lower() for w in x) for x in lines}) / len(lines), worst(1), worst(2), worst(3), sum(m for m, s, u, r in stats if s > 0.3 or u > 0.5 or r > 0.3) / n, mean(lambda w: len(w) <= 3), min(100.0, n / len(lines)) / 100, 0.0,
    ]


def test_quality_features_like_plain_code(monkeypatch):
    rng = random.Random(11)
    parts = ["the", "The", "DATA", "Ünïcödé", "日本語", "a|b", "|", "wow!", "x" * 14, "12.5%", "end.", "(see)", "😀", "\n", "\n\n", "\t", "#"]
    texts = [None, "", " \n ", "one", "same " * 700, "A B\n" * 40] + [" ".join(rng.choice(parts) for _ in range(rng.randrange(1, 120))) for _ in range(300)]
    want = [plain_features(t or "") for t in texts]
    assert np.allclose(quality.feature_table(pa.array(texts)), want)
    assert np.allclose(quality.feature_table(pa.array(["x", *texts])[1:]), want)
    monkeypatch.setattr(quality, "CHUNK", 64)
    assert np.allclose(quality.feature_table(pa.array(texts)), want)


def spark_hash(*values):
    """xxhash64 of int and long columns, as a number in [0, 1)."""
    h = 42
    for kind, v in values:
        h = xxhash.xxh64_intdigest(struct.pack(kind, v), seed=h)
    return (h >> 11) / float(1 << 53)


def test_mixing_recomputed_row_by_row(spark):
    from gatelake.llm import mixing

    rows = duckdb.sql("SELECT doc_id, text, lang, source FROM '/root/testdata/sf0.001/documents.parquet'").fetchall() + [(10**9, None, None, "s9"), (10**9 + 1, "ab 1", "xx", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r["mix"] for r in mixing.mix(df).collect()}

    def topic(t):
        return "legal" if "licens" in t.lower() else "records" if any("0" <= c <= "9" for c in t) else "long" if len(t) > 4000 else "prose"

    cell = {i: (s or "", x or "", topic(t or "")) for i, t, x, s in rows}
    tokens = {i: -(-len((t or "").encode()) // 4) for i, t, _, _ in rows}
    mass = {}
    for i, c in cell.items():
        mass[c] = mass.get(c, 0) + tokens[i]
    total = sum(mass.values())
    share = {c: m / total for c, m in mass.items()}
    want = []
    for d, power in enumerate((0.5, 0.7, 1.0)):
        own = {}
        for c, m in mass.items():
            own[c[d]] = own.get(c[d], 0) + m
        scale = sum(v**power for v in own.values())
        want.append({k: v**power / scale for k, v in own.items()})
    x = dict(share)
    for _ in range(400):
        for d in range(3):
            have = {}
            for c, v in x.items():
                have[c[d]] = have.get(c[d], 0) + v
            x = {c: v * want[d][c[d]] / have[c[d]] if have[c[d]] else 0.0 for c, v in x.items()}
    weight = {c: x[c] / share[c] if share[c] else 0.0 for c in mass}
    low, high = 0.0, 1e9  # the scale by halving
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(1.0, weight[c] * mid) * m for c, m in mass.items()) < mixing.SHARE * total else (low, mid)
    for i, c in cell.items():
        p = min(1.0, weight[c] * low)
        assert (got[i]["source"], got[i]["lang"], got[i]["topic"], got[i]["n_tokens"]) == (*c, tokens[i])
        assert got[i]["weight"] == pytest.approx(weight[c], rel=1e-6) and got[i]["probability"] == pytest.approx(p, rel=1e-6)
        draw = spark_hash(("<i", 0), ("<q", i))
        assert abs(draw - p) < 1e-6 or got[i]["selected"] == (draw < p)
