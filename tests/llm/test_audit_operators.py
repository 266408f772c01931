"""License scans, source divergence and hard negatives against brute force and their SQL."""

import random
from collections import Counter

import duckdb
import numpy as np
import pytest

from glyphflow.llm import divergence, hard_negatives, license_scans, registry

from ..conftest import SF

NAN, INF = float("nan"), float("inf")


@pytest.mark.parametrize("name", ["op11_license_scans", "op12_divergence", "op13_hard_negatives"])
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = registry.queries()[name](spark, SF).toPandas(), con.sql(registry.oracle_sql()[name]).df()
    key = list(got.columns)
    show = lambda f: sorted(map(str, f[key].astype(object).where(f[key].notna(), None).itertuples(index=False, name=None)))
    assert len(got) and show(got.astype({"first_word": float, "last_word": float}) if "first_word" in key else got) == show(want.astype({"first_word": float, "last_word": float}) if "first_word" in key else want)


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def notices_by_hand(words: list[bytes], notices) -> dict:
    """Edits of every word span within a notice's edits, by dynamic programming over all spans."""
    out = {}
    for k, notice in enumerate(notices):
        for i in range(len(words)):
            for j in range(i, min(len(words), i + len(notice.text.split()) + notice.edits)):
                span = b" ".join(words[i : j + 1]).decode("latin-1")
                if abs(len(span) - len(notice.text)) <= notice.edits and (span + " ").startswith(notice.head):
                    e = distance(span, notice.text)
                    if e <= notice.edits:
                        out[k, i, j + 1 - i] = e
    return out


def edited(text: str, edits: int, draw: random.Random) -> str:
    letters = list(text)
    for _ in range(edits):
        at, kind = draw.randrange(len(letters)), draw.randrange(3)
        letters[at : at + (kind != 1)] = [] if kind == 0 else [draw.choice("abcxyz é")]
    return "".join(letters)


def test_seeds_find_every_notice_within_its_edits():
    draw = random.Random(4)
    finder = license_scans.Finder(license_scans.NOTICES)
    found = 0
    for _ in range(120):
        parts = [edited(n.text, draw.randrange(n.edits + 3), draw) for n in draw.choices(license_scans.NOTICES, k=3)]
        words = license_scans.split_words(" cc licence gnu the ".join(parts).encode())
        want, got = notices_by_hand(words, license_scans.NOTICES), finder.hits(words)
        assert {(k, i, n): e for k, i, n, e in got}.items() <= want.items()
        assert {h[:3] for h in got if h[3] == 0} == {h for h, e in want.items() if e == 0}
        for (k, i, n), e in want.items():  # what isn't reported overlaps a better one
            assert any(a == k and b < i + n and i < b + m and f <= e for a, b, m, f in got)
        found += len(want)
    assert found > 150


def test_pieces_leave_one_untouched():
    for notice in license_scans.NOTICES:
        cut = license_scans.pieces(notice)
        assert len(cut) == notice.edits + 1 and "".join(p for _, p in cut) == notice.text
        assert all(notice.text[at : at + len(p)] == p for at, p in cut)


def test_license_spans_and_odd_rows(spark):
    rows = [
        (1, None), (1, None), (2, ""), (None, "MIT  License"), (3, "ünder the GNU Genral-Public\nLicence, v3. CC-BY 4.0; cc by-sa"), (4, "word " * 60_000 + "Apache License."),
        (5, "x" * 300_000), (6, "it license, mitlicense"), (7, "mit license mit license"),
    ]
    docs = spark.createDataFrame([(d, t, 0, "a", 1) for d, t in rows], "doc_id long, text string, hits int, label string, n_words int")
    found = license_scans.scan(docs)
    text = {d: t for d, t in rows}
    hits = [(r["doc_id"], h) for r in found.collect() for h in r["hits"]]
    spans = {(d, h["label"], text[d][h["char_start"] : h["char_end"]], h["edits"]) for d, h in hits}
    assert (3, "gpl", "GNU Genral-Public\nLicence", 2) in spans and (3, "cc-by", "CC-BY", 0) in spans and (3, "cc-by-sa", "cc by-sa", 0) in spans
    got = {r["doc_id"]: tuple(r)[1:] for r in license_scans.summary(found).collect()}
    assert got[1] == (0, 0, None, None, "", "", 0.0) and got[2] == got[1]
    assert got[None] == (2, 1, 0, 0, "mit", "mit", 1.0)
    assert got[3][:5] == (14, 2, 7, 11, "cc-by") and got[3][5] == "cc-by,cc-by-sa,gpl"
    assert got[4] == (60_002, 1, 60_000, 60_000, "apache", "apache", 1.0)
    assert got[5] == (1, 0, None, None, "", "", 0.0) and got[6] == (3, 0, None, None, "", "", 0.0)
    assert got[7] == (4, 2, 0, 2, "mit", "mit", 1.0)
    assert license_scans.summary(found).count() == len(rows)
    assert license_scans.summary(license_scans.scan(docs.limit(0))).count() == 0


def divergence_by_hand(rows, least_docs, top):
    word = lambda t: "".join(c.lower() if c.isascii() and c.isalpha() else c if ord(c) > 127 else " " for c in t or "").split(" ")
    counts, held, groups = {}, {}, {}
    for lang, source, text in ((a or "", b or "", [w for w in word(c) if w]) for a, b, c in rows):
        groups.setdefault(lang, set()).add(source)
        counts.setdefault((lang, source), Counter()).update(text)
        held.setdefault(lang, Counter()).update(set(text))
    out = []
    for lang, sources in groups.items():
        kept = sorted((t for t, n in held[lang].items() if n >= least_docs), key=lambda t: t.encode())
        every = sum((counts[lang, s] for s in sources), Counter())
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[x] for x in kept) + 2 * len(kept)) for t in kept}
        f = lambda p, q: (p - q) ** 2 // (p + q)
        q, p = share(every), {s: share(counts[lang, s]) for s in sources}
        for s in sources:
            pairs = [("pair", o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [("term", t, f(p[s][t], q[t])) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for found, most in ((pairs, len(pairs)), (terms, top)):
                out += [(lang, s, *row, k) for k, row in enumerate(sorted(found, key=lambda r: (-r[2], r[1].encode()))[:most], 1)]
    return sorted(out)


@pytest.mark.parametrize("bits", [2, 12])
def test_divergence_matches_brute_force(spark, monkeypatch, bits):
    monkeypatch.setattr(divergence, "CHUNK_BITS", bits)
    monkeypatch.setattr(divergence, "BLOCK", 2 if bits == 2 else 256)
    monkeypatch.setattr(divergence, "HELD", 50 if bits == 2 else 400_000)
    draw = random.Random(1)
    rows = [(draw.choice(["en", "de", None, "xx"]), draw.choice(["a", "b", "", None, "Ж", "hot", "hot", "hot"]), " ".join(draw.choices(["Alpha", "beta", "über", "naïve,x", "b2b", "ſ", "日本", "𝔘"], k=draw.randrange(9)))) for _ in range(150)]
    rows += [("alone", "only", None), ("bare", "p", "one"), ("bare", "q", ""), ("hot", "h", "Word " * 70_000)] + [("hot", "h", "word")] * 12
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "lang string, source string, text string, term int, n int")
    got = divergence.source_divergence(docs, least_docs=3, top=4)
    assert sorted(map(tuple, got.collect())) == divergence_by_hand(rows, 3, 4)
    assert divergence.source_divergence(docs.limit(0)).count() == 0


def test_shares_are_exact():
    draw = random.Random(2)
    count = np.array([0, 1, 7, *(draw.randrange(10**13) for _ in range(500))])
    total = int(count.sum()) // 40 + int(count.max()) + 2
    assert divergence.shares(count, total).tolist() == [1 + 10**9 * (int(c) + 2) // total for c in count]
    with pytest.raises(OverflowError):
        divergence.shares(count, 1 << 60)


def negatives_by_hand(rows, anchors, most, share):
    whole = lambda v: [int(np.floor(256 * float(x))) for x in v]
    usable = [(i, whole(v), c) for i, v, c in rows if None not in (i, v, c) and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, own, label in {(i, tuple(v), c) for i, v, c in usable if i in anchors}:
        scored = sorted((-sum(x * y for x, y in zip(own, v, strict=False)), i, c) for i, v, c in usable if i != a)
        for s, p, _ in [r for r in scored if r[2] == label][:most]:
            fit = [r for r in scored if r[2] != label and share * -s <= 100 * -r[0] <= 100 * -s][:most]
            out += [(a, p, k, n, -s, -t) for k, (t, n, _) in enumerate(fit, 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [3, 8192])
def test_hard_negatives_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", block)
    monkeypatch.setattr(hard_negatives, "BLOCK_ANCHORS", block)
    draw = random.Random(9)
    near = [[draw.choice([0.0, 0.25, 0.26, -0.1, 1.0]) for _ in range(3)] for _ in range(6)]
    rows = [(i, draw.choice(near) if i % 3 else [draw.gauss(0, 1) for _ in range(3)], draw.choice([0, 0, 1, 2])) for i in range(80)]
    rows += [(5, [0.1, 0.2, 0.3], 1), (4, rows[4][1], rows[4][2]), (100, None, 1), (101, [1.0, NAN, 0.0], 1), (102, [1.0, INF, 0.0], 1), (103, [1.0, None, 0.0], 0)]
    rows += [(104, [0.5], 0), (105, [], 0), (106, [0.5, 0.5, 0.5, 9.0], 2), (None, [1.0, 1.0, 1.0], 1), (107, [1.0, 1.0, 1.0], None), (108, [3e12, -3e12, 1.0], 0), (109, [2e9, 7.0, 1.0], 0), (110, [2e9, 1.0, 1.0], 1)]
    vectors = spark.createDataFrame([(*r, 0, "x") for r in rows], "vec_id long, embedding array<double>, label int, rank int, key string")
    anchors = set(range(0, 80, 4)) | {5, 100, 105, 108, 109}
    exact = [r for r in negatives_by_hand(rows, anchors, 3, 80) if all(abs(s) < 1 << 63 for s in r[4:])]
    got = hard_negatives.hard_negatives(vectors, vectors.where(vectors["vec_id"].isin(sorted(anchors))), 3, 3)
    assert [r for r in sorted(map(tuple, got.collect())) if all(abs(s) < (1 << 63) - 1 for s in r[4:])] == exact and len(exact) > 100
    assert hard_negatives.hard_negatives(vectors.limit(0), vectors.limit(0)).count() == 0
