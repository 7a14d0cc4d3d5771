"""Every operator against a brute-force version on a small, awkward table."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from custspark.llm import bpe, hyperplane, jaccard, pfor, separators, shards, substring, suffixes, toxicity, warc
from custspark.llm.components import components
from custspark.llm.queries import tokenizer_path

SPACE = re.compile("[^\x20\x09-\x0D]+")
ALNUM = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def got(df, *cols):
    return Counter(tuple(r) for r in df.select(*cols).collect())


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(tokenizer_path())


def ids_of(tok, text):
    return tok.encode(text or "", add_special_tokens=False).ids


def test_bpe_roundtrip(docs, rows, empty, tok):
    want = Counter((r[0], len(ids_of(tok, r[1])), hashlib.sha256(np.array(ids_of(tok, r[1]), "<u4").tobytes()).hexdigest(),
                    hashlib.sha256(tok.decode(ids_of(tok, r[1]), skip_special_tokens=False).encode()).hexdigest()) for r in rows)
    assert got(bpe.roundtrip_digest(docs, tokenizer_path()), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want
    texts = {(r.doc_id, r.decoded) for r in bpe.encode(docs, tokenizer_path(), with_text=True).collect()}
    assert texts == {(r[0], r[1] or "") for r in rows}
    assert bpe.encode(empty, tokenizer_path()).count() == 0


def test_bpe_cuts_agree_with_whole_texts(tok):
    import pyarrow as pa

    from custspark.llm.common import text_buffers
    rng = random.Random(5)
    parts = [*"ab zZ'sltredvm019!?.,\n\t 　é日́<|>\u0085", "<|endoftext|>", "  ", "'ll", " "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 50))) for _ in range(3000)]
    c = bpe.Codec(tokenizer_path())
    ids, at = c.encode(*text_buffers(pa.array(texts)))
    for i, t in enumerate(texts):
        assert ids[at[i]:at[i + 1]].tolist() == ids_of(tok, t), t
        assert c.decode(ids[at[i]:at[i + 1]]) == t


def test_pfor_blocks():
    rng = np.random.default_rng(1)
    for x in (np.zeros(0, np.uint32), rng.integers(0, 50257, 5000, dtype=np.uint32), np.full(3000, 7, np.uint32),
              np.where(rng.random(4096) < 0.01, 2**32 - 1, rng.integers(0, 9, 4096)).astype(np.uint32)):
        blocks = pfor.encode_blocks(x)
        assert len(blocks) == -(-len(x) // pfor.BLOCK)
        assert (pfor.decode_blocks(blocks) == x).all() if len(x) else not blocks


def test_token_files(docs, rows, empty, tok):
    out = pfor.token_files(docs, tokenizer_path(), end_id=2, with_ids=True).orderBy("start").collect()
    want = Counter((r[0], tuple(ids_of(tok, r[1]) + [2])) for r in rows)
    assert Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in out) == want
    at = 0
    for r in out:
        assert r.start == at and r.n_tokens == len(r.ids) // 4 and r.ids_crc32 == zlib.crc32(r.ids)
        at += r.n_tokens
    known = [r.doc_id for r in out if r.doc_id is not None]
    assert known == sorted(known)
    assert pfor.token_files(empty, tokenizer_path()).count() == 0


def test_separator_scan(docs, rows, empty, tok):
    tok2 = Tokenizer.from_file(tokenizer_path())
    tok2.encode_special_tokens = True
    out = separators.token_counts(docs, tokenizer_path(), 50256, block_bytes=512)  # documents run over many blocks
    assert got(out, "doc_id", "n_tokens") == Counter((r[0], len(ids_of(tok2, r[1]))) for r in rows)
    assert separators.token_counts(empty, tokenizer_path(), 50256).count() == 0


def test_separator_tail(spark, tmp_path):
    x = np.array([5, 9, 9, 1, 2, 9, 3, 4, 4, 4, 4], "<u2")
    (tmp_path / "t.u16").write_bytes(x.tobytes())
    (tmp_path / "e.u16").write_bytes(b"")
    files = spark.createDataFrame([(str(tmp_path / "t.u16"),), (str(tmp_path / "e.u16"),)], "file string")
    out = got(separators.scan(files, 9, 4), "doc_no", "start", "n_tokens", "terminated")
    assert out == Counter([(0, 0, 1, True), (1, 2, 0, True), (2, 3, 2, True), (3, 6, 5, False)])


def brute_jaccard(rows):
    sets = []
    for r in rows:
        w = SPACE.findall((r[1] or "").translate(LOWER))
        sets.append(frozenset(tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))) if w else frozenset())
    comp = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = comp[i], comp[j]
                comp = [b if c == a else c for c in comp]
    out = []
    for i, r in enumerate(rows):
        ids = [x[0] for x, c in zip(rows, comp) if c == comp[i] and x[0] is not None]
        out.append((r[0], len(sets[i]), r[0] if not sets[i] else min(ids, default=None)))
    return out


def test_jaccard_join(docs, rows, empty):
    assert got(jaccard.near_duplicates(docs), "doc_id", "n_shingles", "component_id") == Counter(brute_jaccard(rows))
    assert jaccard.near_duplicates(empty).count() == 0
    kept = jaccard.keep_first(docs)
    assert kept.columns == docs.columns
    classes = {c for _, n, c in brute_jaccard(rows) if n}
    assert {r.doc_id for r in kept.collect() if (r.text or "").split()} == classes


def test_jaccard_join_whatever_the_sample(docs, rows, monkeypatch):
    """The sample that orders the shingles decides no row: without any, and with every sampled shingle called frequent, classes and links stay."""
    want, links = Counter(brute_jaccard(rows)), Counter(brute_links(rows))
    for size, least in ((0, 3), (64 << 20, 1)):
        monkeypatch.setattr(jaccard, "SAMPLE_BYTES", size)
        monkeypatch.setattr(jaccard, "FREQUENT", least)
        out = jaccard.near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "n_links").collect()
        assert Counter((r[0], r[1], r[2]) for r in out) == want
        assert Counter((r[0], r[3]) for r in out) == links


def test_keep_first_by_class(spark):
    """Classes without an id, or with the same least id, keep a row each."""
    text = lambda c: " ".join(f"{c}{i}" for i in range(60))
    rows = [(None, text(c)) for c in "abcde"] + [(None, text("a") + " x"), (3, text("f")), (3, text("g")), (4, text("g") + " x"),
                                                 (None, text("h")), (9, text("h") + " x"), (None, None)]
    kept = got(jaccard.keep_first(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)), "doc_id", "text")
    first = [(None, text("a")), (None, text("a") + " x")]
    assert sum(kept[r] for r in first) == 1
    assert kept - Counter(first) == Counter([*[(None, text(c)) for c in "bcde"], (3, text("f")), (3, text("g")), (9, text("h") + " x"), (None, None)])


def test_keep_first_of_repeated_rows(spark):
    """Of rows equal in id and text one stays, and its text outlasts the substring stage."""
    text = lambda c: " ".join(f"{c}{i}" for i in range(60))
    rows = [(7, text("a"))] * 3 + [(None, text("b"))] * 3 + [(8, text("c"))] + [(9, None)] * 2
    kept = jaccard.keep_first(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    want = Counter([(7, text("a")), (None, text("b")), (8, text("c")), (9, None), (9, None)])
    assert got(kept, "doc_id", "text") == want
    assert got(substring.deduplicate(kept, replace=True), "doc_id", "text") == want


def brute_links(rows):
    sets = []
    for r in rows:
        w = SPACE.findall((r[1] or "").translate(LOWER))
        sets.append(frozenset(tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))) if w else frozenset())
    return [(r[0], sum(i != j and bool(s) and 100 * len(s & o) >= 75 * len(s | o) for j, o in enumerate(sets)))
            for i, (r, s) in enumerate(zip(rows, sets))]


def test_jaccard_link_counts(spark, docs, rows, monkeypatch):
    """Every link counts once, also within a class that meets block by block."""
    assert got(jaccard.near_duplicates(docs), "doc_id", "n_links") == Counter(brute_links(rows))
    rng = random.Random(8)
    base = [f"w{i}" for i in range(200)]
    near = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randrange(10)):
            w[rng.randrange(200)] = f"x{rng.randrange(1000)}"
        near.append((i, " ".join(w)))
    near += [(60, near[1][1]), (61, near[1][1].upper()), (62, "alone"), (63, None)]
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    out = jaccard.near_duplicates(spark.createDataFrame(near, "doc_id long, text string").repartition(3))
    want = Counter(brute_links(near))
    assert max(n for _, n in want) > 16 and got(out, "doc_id", "n_links") == want


def test_voronoi_cells_of_a_large_class(spark, monkeypatch):
    """A long chain of linked texts is divided over several rounds; links and classes stay whole."""
    rows = [(i, " ".join(f"w{j}" for j in range(3 * i, 3 * i + 120))) for i in range(500)]
    rows += [(1200 + i, r[1]) for i, r in enumerate(rows[:3])] + [(999, "alone"), (None, rows[70][1].upper())]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    made = []
    divide = jaccard.voronoi_cells

    def watched(*args):
        out = divide(*args)
        made.append({(r.cell, r.node, r.mine) for r in out.collect()})
        return out

    monkeypatch.setattr(jaccard, "BLOCK", 24)
    monkeypatch.setattr(jaccard, "voronoi_cells", watched)
    out = got(jaccard.near_duplicates(docs), "doc_id", "n_shingles", "component_id", "n_links")
    links = brute_links(rows)
    assert out == Counter((*b, n) for b, (_, n) in zip(brute_jaccard(rows), links))
    assert jaccard.keep_first(docs).count() == 2
    for cells in made:
        assert len({c for c, *_ in cells}) > 8 and max(Counter(c for c, *_ in cells).values()) < 250
        assert Counter(n for _, n, mine in cells if mine) == Counter({n for _, n, _ in cells})


def test_count_links_beyond_a_leaf():
    """Cells and blocks find all links, and two sets of a block that is not at home count elsewhere."""
    rng = np.random.default_rng(6)
    for groups, each in ((90, 5), (1, 400)):
        sets = []
        for _ in range(groups):
            base = rng.integers(0, 1 << 60, 60, dtype=np.uint64)
            for e in range(each):
                s = base.copy()
                s[:e % 5 * 4] = rng.integers(0, 1 << 60, e % 5 * 4, dtype=np.uint64)
                sets.append(np.unique(s))
        times, block = rng.integers(1, 4, len(sets)), np.arange(len(sets)) % 2
        inter = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets[:60]])
        size = np.array([len(s) for s in sets])
        near = 100 * inter >= 75 * (size[:60, None] + size[None, :] - inter)
        near[np.arange(60), np.arange(60)] = False
        for home in (True, False):
            own = near & ((block[:60, None] != block[None, :]) | (block[None, :] == 0) | home)
            n = jaccard.count_links(sets, times, block, (block == 0) | home, 75, jaccard.Union(len(sets)))
            assert (n[:60] == own @ times).all()


def test_join_region_recursion():
    """More sets than a leaf: pivots and cells find what all pairs find."""
    rng = np.random.default_rng(3)
    sets = []
    for g in range(90):
        base = rng.integers(0, 1 << 60, 60, dtype=np.uint64)
        for e in range(5):
            s = base.copy()
            s[:e * 4] = rng.integers(0, 1 << 60, e * 4, dtype=np.uint64)
            sets.append(np.unique(s))
    a, b = jaccard.Union(len(sets)), jaccard.Union(len(sets))
    jaccard.join_region(sets, 75, a)
    for i in range(len(sets)):
        for j in range(i):
            n = len(np.intersect1d(sets[i], sets[j]))
            if 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                b.join(i, j)
    assert (a.roots() == b.roots()).all()
    c = jaccard.Union(len(sets))
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    jaccard.may_link(np.diff(bounds), jaccard.bitmaps(np.concatenate(sets), bounds), 75, c)
    assert all(c.root(i) == c.root(int(r)) for i, r in enumerate(a.roots()))  # the bitmaps lose no link


def brute_windows(rows, window):
    words = [SPACE.findall(r[1] or "") for r in rows]
    seen = Counter(tuple(w[i:i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for r, w in zip(rows, words):
        keep = [True] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i:i + window])] > 1:
                keep[i:i + window] = [False] * window
        out.append((r[0], len(w), len(w) - sum(keep), " ".join(x for x, k in zip(w, keep) if k)))
    return out


@pytest.mark.parametrize("window,gram", [(35, 12), (6, 3)])
def test_substring_dedup(docs, rows, empty, window, gram):
    out = substring.deduplicate(docs, window, gram)
    assert got(out, "doc_id", "n_words", "n_removed", "kept") == Counter(brute_windows(rows, window))
    assert substring.deduplicate(empty, window, gram).count() == 0


def test_substring_replaces_texts(docs, rows):
    out = substring.deduplicate(docs, replace=True)
    want = Counter((r[0], r[1] if not n else kept) for r, (_, _, n, kept) in zip(rows, brute_windows(rows, 35)))
    assert out.columns == docs.columns and got(out, "doc_id", "text") == want


def test_rows_of_one_id_and_clashing_columns(spark):
    """Texts of one id keep their own runs; columns with the operators' own names pass through."""
    text = lambda c, n=60: " ".join(f"{c}{i}" for i in range(n))
    rows = [(1, text("a")), (1, text("b")), (None, text("a") + " end"), (None, text("c")), (0, text("c", 40)), (0, text("d")), (2, None)]
    names = ("__id", "__key", "__text", "__RUNS", "__row", "key", "node")
    docs = spark.createDataFrame([(*r, *[f"{n}{i}" for n in names]) for i, r in enumerate(rows)],
                                 "doc_id long, text string, " + ", ".join(f"{n} string" for n in names)).repartition(3)
    want = brute_windows(rows, 35)
    assert got(substring.deduplicate(docs), "doc_id", "n_words", "n_removed", "kept") == Counter(want)
    replaced = substring.deduplicate(docs, replace=True)
    assert replaced.columns == docs.columns
    assert got(replaced, "__row", "text") == Counter((f"__row{i}", r[1] if not n else kept) for i, (r, (_, _, n, kept)) in enumerate(zip(rows, want)))
    kept = jaccard.keep_first(docs)
    assert kept.columns == docs.columns and {r["__row"] for r in kept.collect()} == {f"__row{i}" for i in (0, 1, 3, 4, 5, 6)}


def test_shards_keep_small_groups_together(spark):
    """A group of equal texts of less than a sixteenth of a share is never cut, a larger one may be."""
    rows = [(i, f"text {i // 5} " + "x" * 40) for i in range(4000)] + [(5000 + i, "hot") for i in range(40_000)]
    out = shards.shard(spark.createDataFrame(rows, "doc_id long, text string"), 8).collect()
    text = dict(rows)
    where = {}
    for r in out:
        where.setdefault(text[r.doc_id], set()).add(r["shard"])
    assert len(where.pop("hot")) > 1 and all(len(s) == 1 for s in where.values())
    share = sum(r.size for r in out) / 8
    for s in range(8):
        own = [r for r in out if r["shard"] == s]
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert abs(sum(r.size for r in own) - share) <= share / 8


def test_shards(docs, rows, empty):
    out = shards.shard(docs, 4).collect()
    size = lambda t: len((t or "").encode()) + 1
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter(
        (r[0], size(r[1]), zlib.crc32((r[1] or "").encode())) for r in rows)
    total, largest = sum(r.size for r in out), max(r.size for r in out)
    for s in range(4):
        own = [r for r in out if r["shard"] == s]
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert sum(r.size for r in own) <= total / 4 + largest
    assert shards.shard(empty).count() == 0


def test_shards_subdivide_overfull_ranges(spark, monkeypatch):
    monkeypatch.setattr(shards, "SAMPLE", 4)
    monkeypatch.setattr(shards, "RANGES", 32)
    df = spark.range(3000).selectExpr("id as doc_id", "cast('same text' as string) text")
    out = shards.shard(df, 8).groupBy("shard").count().collect()
    assert sorted(r["count"] for r in out) == [375] * 8


def test_hyperplanes(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((30, 16))
    vecs = [b + rng.standard_normal(16) * s for b in base for s in (0, 0.1, 0.2)] + [np.zeros(16), base[0] * 3]
    data = [(i, [float(x) for x in v]) for i, v in enumerate(vecs)]
    data += [(500, None), (501, []), (502, [1.0, None]), (503, [float("nan")] * 16), (504, data[4][1]), (504, data[4][1]),
             (None, [1.0, 0.0]), (505, [2.0, 0.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in data], "vec_id long, embedding array<double>, n int")
    usable = [v if v and all(x is not None and x == x for x in v) and any(v) else None for _, v in data]
    links, comp = [0] * len(data), list(range(len(data)))
    for i, a in enumerate(usable):
        for j, b in enumerate(usable[:i]):
            if a and b and len(a) == len(b) and np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b) >= 0.9:
                links[i] += 1
                links[j] += 1
                x, y = comp[i], comp[j]
                comp = [y if c == x else c for c in comp]
    want = []
    for i, (v, _) in enumerate(data):
        ids = [data[j][0] for j in range(len(data)) if comp[j] == comp[i] and data[j][0] is not None]
        want.append((v, links[i], min(ids, default=None)))
    out = hyperplane.near_duplicates(df, recall=0.9999)
    assert got(out, "vec_id", "n_links", "component_id") == Counter(want)
    assert hyperplane.near_duplicates(df.where("false")).count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(400, 460)] + [(7, None), (8, 8)]
    out = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    up = jaccard.Union(500)
    for a, b in edges:
        if b is not None:
            up.join(a, b)
    nodes = {x for a, b in edges if b is not None and a != b for x in (a, b)}
    assert out == {x: up.root(x) for x in nodes}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_contamination(rows, items, window=10):
    wins = {}
    for item, text in items:
        w = ALNUM.findall((text or "").translate(LOWER))
        for i in range(max(len(w) - window, 0) + 1 if w else 0):
            wins.setdefault(tuple(w[i:i + window]), set()).add("null" if item is None else str(item))
    out = []
    for r in rows:
        w = ALNUM.findall((r[1] or "").translate(LOWER))
        hit, found = [False] * len(w), set()
        for n in {len(x) for x in wins}:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in wins:
                    found |= wins[tuple(w[i:i + n])]
                    hit[i:i + n] = [True] * n
        out.append((r[0], len(w), sum(hit), tuple(sorted(found))))
    return out


def test_suffix_arrays(spark, docs, rows, empty):
    text = next(r[1] for r in rows if r[0] == 64)
    long = ALNUM.findall(text.translate(LOWER))
    items = [(1, " ".join(long[100:140])), (2, " ".join(long[120:135]).upper()), (2, " ".join(long[300:309])), (None, " ".join(long[50:61])),
             (3, None), (4, "!!"), (10, " ".join(long[5000:5030]) + " zzz " + " ".join(long[10:22])), (11, rows[41][1])]
    tests = spark.createDataFrame(items, "item_id long, text string")
    out = suffixes.contamination(docs, tests).collect()
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in out) == Counter(brute_contamination(rows, items))
    best = next(r for r in out if r.doc_id == 64)
    assert (best.longest, best.longest_at, best.longest_item) == (40, 100, "1")
    clean = Counter((r[0], r[1]) for r, b in zip(rows, brute_contamination(rows, items)) if not b[2])
    kept = suffixes.decontaminate(docs, tests)
    assert kept.columns == docs.columns and got(kept, "doc_id", "text") == clean
    assert suffixes.contamination(docs, tests.where("false")).where("n_hit > 0").count() == 0
    assert suffixes.contamination(empty, tests).count() == 0


def test_warc(spark):
    big = "<p>é</p>" * 40
    pages = [(3, "http://a", big, 1), (1, "http://b\r\nX: y", big, 1), (7, None, big, 1), (2, "u", "short", 1), (4, "u", "short", 1),
             (5, "u", None, 1), (6, "u", "", 1), (None, "u", big, 1), (8, "u", "\r\n\r\n" * 50, 1), (9, "u", "x" * 300_000, 1), (7, None, big, 1)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, digest int").repartition(2)
    first = {}
    for p, _, h, _ in pages:
        if p is not None and len((h or "").encode()) >= 100:
            first[h] = min(p, first.get(h, p))
    want = Counter()
    for p, _, h, _ in pages:
        b = (h or "").encode()
        again = p is not None and h in first and p > first[h]
        want[(p, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[h] if again else None)] += 1
    out = warc.archive(df, with_payload=True)
    assert got(out, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == want
    assert warc.archive(df.where("false")).count() == 0


def test_maximal_segments():
    rng = random.Random(2)
    for _ in range(300):
        x = np.array([rng.choice([-2.0, -1.0, 0.5, 1.5]) for _ in range(rng.randint(0, 25))])
        segments = toxicity.maximal_segments(x)
        assert all(abs(s - x[a:b].sum()) < 1e-9 and s > 0 for a, b, s in segments)
        assert all(a[1] <= b[0] for a, b in zip(segments, segments[1:]))
        best = max([x[i:j].sum() for i in range(len(x)) for j in range(i + 1, len(x) + 1)], default=0)
        assert abs(max([s for *_, s in segments], default=0) - max(best, 0)) < 1e-9


def test_toxicity_keeps_all_words_that_count(spark, monkeypatch):
    """No bound on the number of word scores."""
    monkeypatch.setattr(toxicity, "MAX_WORDS", 5, raising=False)
    rng = random.Random(7)
    bad = [f"bad{i}" for i in range(12)]
    rows = [(i, " ".join([f"w{rng.randrange(300)}" for _ in range(60)] + [w for b in bad for w in (b, f"w{rng.randrange(300)}") if i % 3 == 0]))
            for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert (model.scores.scores > 2).sum() >= len(bad)


def test_toxicity(spark, empty):
    rng = random.Random(6)
    vocab = [f"w{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(600):
        words = [rng.choice(vocab) for _ in range(rng.randint(20, 120))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(4):
                words[rng.randrange(len(words))] = rng.choice(["scum", "moron", "trash"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    rows += [(1000, None), (1001, ""), (None, "scum moron trash scum moron"), (1002, " ".join(rng.choices(vocab, k=20_000)))]
    labels += [(None, 1), (1001, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, lab)
    out = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 3 == 1]
    right = [(out[i].score >= 0.7) == (i % 5 == 0) for i in held]
    assert sum(right) / len(right) > 0.97
    assert out[None].score >= 0.7 and max(out[i].score for i in (1000, 1001, 1002)) < 0.3 and all(0 <= r.score <= 1 for r in out.values())
    assert out[0].passages and not out[1].passages
    assert {r.doc_id for r in toxicity.reject(docs, model).collect()} == {i for i, r in out.items() if r.score < 0.7}
    flat = toxicity.fit(docs, lab.where("false"))
    assert {r.score for r in toxicity.score(docs, flat).collect()} == {0.0}
    assert toxicity.score(empty, toxicity.fit(empty, lab)).count() == 0


def thue_morse(n, a, b):
    return "".join((a, b)[bin(i).count("1") & 1] for i in range(n))


def test_texts_built_to_collide(spark, tok):
    """Two different texts whose polynomial hashes modulo 2**64 are equal are still told apart by every operator."""
    import pyarrow as pa

    from custspark.llm import suffixes
    from custspark.llm.common import text_buffers
    x, y = thue_morse(2048, "a", "b"), thue_morse(2048, "b", "a")
    c = bpe.Codec(tokenizer_path())
    ids, at = c.encode(*text_buffers(pa.array([x, y, x])))
    for i, t in enumerate((x, y, x)):
        assert ids[at[i]:at[i + 1]].tolist() == ids_of(tok, t)
    words = " ".join(f"w{i}" for i in range(40))
    rows = [(1, f"{x} {words}"), (2, f"{y} {words}"), (3, f"q {x} r s t"), (4, f"q {y} r s t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(jaccard.near_duplicates(docs), "doc_id", "n_shingles", "component_id") == Counter(
        (r[0], n, c) for r, (_, n, c) in zip(rows, brute_jaccard(rows)))
    removed = {r.doc_id: r.n_removed for r in substring.deduplicate(docs).collect()}
    assert removed == {r[0]: n for r, (_, _, n, _) in zip(rows, brute_windows(rows, 35))}
    items = spark.createDataFrame([("i", f"p {y} r s")], "item_id string, text string")
    hit = {r.doc_id: r.n_hit for r in suffixes.contamination(spark.createDataFrame([(1, f"p {x} r s"), (2, f"p {y} r s")], "doc_id long, text string"), items).collect()}
    assert hit == {1: 0, 2: 4}


def test_equal_hashes_are_told_apart_by_bytes(tok, monkeypatch):
    """Even where every piece hashes alike, bytes decide."""
    import pyarrow as pa

    from custspark.llm.common import text_buffers
    monkeypatch.setattr(bpe, "span_hashes", lambda data, start, end: (end - start).astype(np.uint64) % 3)
    texts = ["one two three", "", "owe two free", None, "eno owt", "one two three"]
    c = bpe.Codec(tokenizer_path())
    ids, at = c.encode(*text_buffers(pa.array(texts)))
    for i, t in enumerate(texts):
        assert ids[at[i]:at[i + 1]].tolist() == ids_of(tok, t)


def test_repeated_windows_make_no_pairs():
    """An item and a text of one word, over and over: bounded time and memory."""
    import time
    import tracemalloc

    import pyarrow as pa

    from custspark.llm import suffixes
    blocks = suffixes._Blocks("", 10)
    blocks.kept = [suffixes.Tests([("i", "a " * 2000), ("j", "a " * 1999 + "b")], 10)]
    tracemalloc.start()
    begun = time.time()
    words, hit, n_hit, named, best = suffixes.examine(pa.array(["a " * 20_000, "a " * 300 + "b c", "x"]), blocks)
    assert time.time() - begun < 20 and tracemalloc.get_traced_memory()[1] < 500e6
    tracemalloc.stop()
    assert n_hit.tolist() == [20_000, 301, 0] and [sorted(x) for x in named] == [["i", "j"], ["i", "j"], []]
    assert [x[0] for x in best] == [2000, 301, 0] and best[0][1:] == (0, "i") and best[1][2] == "j"


def test_a_prompt_that_many_items_share(spark, monkeypatch):
    """Ten thousand items begin alike; several blocks of items."""
    from custspark.llm import suffixes
    prompt = " ".join(f"p{i}" for i in range(25))
    items = spark.range(10_000).selectExpr("concat('i', id) as item_id", f"concat('{prompt} own', id, ' tail', id) as text")
    docs = spark.createDataFrame([(1, f"x {prompt} y"), (2, f"{prompt} own7 tail7 z"), (3, "p1 p2 p3")], "doc_id long, text string")
    for size in (suffixes.BLOCK_BYTES, 100_000):
        monkeypatch.setattr(suffixes, "BLOCK_BYTES", size)
        got = {r.doc_id: r for r in suffixes.contamination(docs, items).collect()}
        assert [got[d].n_hit for d in (1, 2, 3)] == [25, 27, 0] and [len(got[d]["items"]) for d in (1, 2, 3)] == [10_000, 10_000, 0]
        assert (got[1].longest, got[1].longest_at, got[1].longest_item) == (25, 1, "i0") and (got[2].longest, got[2].longest_item) == (27, "i7")
