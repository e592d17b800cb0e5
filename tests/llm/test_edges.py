"""Rows that operators must bear: nulls, repeats, ties, empty tables, long texts and clashing columns, each against a plain version."""

import hashlib
import itertools
import math
import random
import threading
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

P = pytest.importorskip("public_tokenizers")

from lodestar.llm import ann, bpe, fingerprint, html_extract, ngram_join, packing, quality, secrets, shingles, substring_dedup, token_counts  # noqa: E402

from .layouts import LAYOUTS  # noqa: E402

TABLES = Path("/root/testdata")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{random.Random(k).randrange(10**6)}x{k}" for k in range(3000)]


def prose(start, n=100):
    return " ".join(WORDS[start : start + n])


def frame(spark, rows, more=""):
    return spark.createDataFrame(rows, "doc_id long, text string" + more).repartition(4)


# ---- op1 ----


def nearest(good, q, k=10):
    return [i for _, i in sorted((float(np.sqrt(((q[1] - y) ** 2).sum())), i) for i, y in good if i != q[0])][:k]


@pytest.mark.skipif(not TABLES.exists(), reason="needs the tables")
def test_ann_recall_on_embeddings(spark):
    v = spark.read.parquet(f"{TABLES}/sf0.01/embeddings.parquet")
    good = [(r.vec_id, np.array(r.embedding, float)) for r in v.collect()]
    got = defaultdict(list)
    for x in ann.op1_collision_ann(spark, f"{TABLES}/sf0.01").orderBy("query_id", "rank").collect():
        got[x.query_id].append(x.vec_id)
    queries = [q for q in good if q[0] % 100 == 0]
    assert set(got) == {q[0] for q in queries} and all(len(x) == 10 for x in got.values())
    assert sum(len(set(nearest(good, q)) & set(got[q[0]])) for q in queries) >= 0.9 * 10 * len(queries)


@pytest.mark.skipif(not TABLES.exists(), reason="needs the tables")
def test_ann_verifies_few(spark):
    rows = spark.read.parquet(f"{TABLES}/sf0.1/embeddings.parquet").collect()
    ids, v = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    index, hits, verified = ann.SortedProjections(ids, v), 0, 0
    queries = [k for k in range(len(ids)) if ids[k] % 100 == 0]
    for k in queries:
        got, dist, count = index.search(ids[k], v[k], 10)
        assert (np.diff(dist) >= 0).all() and ids[k] not in got
        hits += len(set(got.tolist()) & set(nearest(list(zip(ids.tolist(), v, strict=True)), (ids[k], v[k]))))
        verified += count
    assert hits >= 0.9 * 10 * len(queries) and verified < 0.1 * len(ids) * len(queries)


def test_ann_ties_repeats_and_columns(spark):
    r = np.random.default_rng(4)
    rows = [(i, r.standard_normal(6).tolist(), "x", 1) for i in range(300)] + [(i, [2.0] * 6, "x", 2) for i in range(900, 1000)] + [(7, [2.0] * 6, "x", 3), (1000, [2.0] * 6, "x", 4), (1000, [2.0] * 6, "x", 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, side string, block long").repartition(3)
    clean = ann.clean_vectors(df, "vec_id", "embedding")
    got = [(x.rank, x.vec_id, x.score) for x in ann.search(clean.where("id = 900"), clean, block_rows=50).orderBy("rank").collect()]
    assert got == [(1, 7, 0.0)] + [(k + 2, 901 + k, 0.0) for k in range(9)]
    alone = clean.where("id = 1000")
    assert ann.search(alone, alone).count() == 0


# ---- op2 ----

SECRET = "zyxwvu987654"


def test_known_spans(spark):
    hexa = "0123456789abcdef" * 2
    rows = [(1, f"password={SECRET}.", "s1"), (2, f"é {SECRET} again, x={SECRET}!", "s2"), (3, f"in a{SECRET}b or {SECRET}9 no", "s3"), (4, f"token: {hexa}/{SECRET} and {SECRET}", "s4"), (5, None, "s5"), (6, "", None)]
    rows += [(None, f"copied passwd=copied12345 {k}", f"t{k}") for k in range(3)] + [(8, "copied12345", "s6"), (9, "secret=lettersonly", "s7"), (9, "lettersonly", "s7")]
    df = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], DOCS).repartition(3)
    got = sorted((str(x.doc_id), x.spans, x.n_known, x.n_live, x.n_copied) for x in secrets.spans(df).collect())
    at = 7 + len(hexa) + 1
    want = [("1", "assign:0:22", 0, 1, 0), ("2", f"known:2:14,known:24:36", 2, 2, 0), ("3", "", 0, 0, 0), ("4", f"assign:0:{at + 12},hex:7:39,known:{at + 17}:{at + 29}", 1, 3, 0), ("5", "", 0, 0, 0), ("6", "", 0, 0, 0), ("8", "", 0, 0, 0), ("9", "", 0, 0, 0), ("9", "assign:0:18", 0, 1, 0)] + [("None", "assign:7:25", 0, 0, 1)] * 3
    assert got == sorted(want)
    for x in secrets.spans(df).collect():
        base = ",".join(s for s in x.spans.split(",") if s and not s.startswith("known"))
        assert x.base_sha256 == hashlib.sha256(base.encode()).hexdigest()


def test_known_values_are_masked_and_rows_kept(spark):
    rows = [(None, f"password={SECRET}.", "s1"), (None, f"bare {SECRET}, x", "s2"), (None, "nothing here", "s3"), (3, None, None), (3, f"bare {SECRET}", "s1"), (3, "password=copied12345", "a"), (4, "password=copied12345", "b"), (5, "password=copied12345", "c")]
    df = spark.createDataFrame([(i, t, "en", s, 0, "d", "m") for i, t, s in rows], DOCS + ", digests string, own_id string").repartition(3)
    got = secrets.redact(df)
    assert got.columns == df.columns
    want = [(i, t and t.replace(SECRET, secrets.MASK)) for i, t, _ in rows]
    assert Counter((x.doc_id, x.text) for x in got.collect()) == Counter(want)
    assert secrets.redact(df.where("false")).count() == 0


# ---- op3 ----


def plain_chunks(raw):
    out, s, h = [], 0, 0
    hashes = []
    for b in raw:
        h = ((h << 1) + int(fingerprint.GEAR[b])) & 0xFFFFFFFF
        hashes.append(h)
    while s < len(raw):
        e = None
        for k in range(s + fingerprint.LEAST, min(s + fingerprint.MOST, len(raw) + 1)):
            bits = fingerprint.STRICT_BITS if k < s + fingerprint.TARGET else fingerprint.LOOSE_BITS
            if hashes[k - 1] < 1 << (32 - bits):
                e = k
                break
        e = min(e or s + fingerprint.MOST, len(raw))
        out.append(raw[s:e])
        s = e
    return out


def plain_likeness(a, b):
    a, b = set(plain_chunks(a)), set(plain_chunks(b))
    return sum(map(len, a & b)) / sum(map(len, a)) if a else float(not b)


def test_chunks_against_a_plain_chunker():
    r = random.Random(2)
    texts = [bytes(r.randrange(256) for _ in range(n)) for n in (0, 1, 15, 16, 17, 100, 3000)] + [b"a" * 700, "é ü".encode() * 90]
    for t in texts:
        ends = fingerprint.boundaries(np.frombuffer(t, np.uint8))
        assert [t[a:b] for a, b in zip([0, *ends], ends, strict=False)] == plain_chunks(t)
    long = np.random.default_rng(1).integers(0, 256, (1 << 22) + 50_000, dtype=np.uint8).tobytes()
    ends = fingerprint.boundaries(np.frombuffer(long, np.uint8))
    at = max(k for k, e in enumerate(ends) if e < (1 << 22) - 2000)  # from a boundary on, over the end of the first segment
    tail = long[ends[at] - 64 :]
    mine = [e - (ends[at] - 64) for e in ends[at:]]
    own = np.cumsum([len(c) for c in plain_chunks(tail)]).tolist()
    assert set(mine[-200:]) <= set(own)


@pytest.mark.parametrize("buckets", [1, 7, 40])
def test_fingerprint_neighbours(spark, buckets):
    r = random.Random(buckets)
    rows = [(r.choice([None, 3, 3, *range(100)]), r.choice([None, "", prose(r.randrange(200), 60), prose(0, 50)]), 1) for _ in range(60)]
    df = frame(spark, rows, ", k long")
    got = fingerprint.fingerprints(df).collect()
    # ids descending, null first; within an id by the hash of the text, descending
    marks = {t: spark.sql("select xxhash64(:t)", args={"t": t}).first()[0] for t in {t or "" for _, t, _ in rows}}
    order = sorted(((i is None, i or 0, marks[t or ""], t or "") for i, t, _ in rows), reverse=True)
    want = Counter()
    for k, (none, i, _, t) in enumerate(order):
        n = order[(k + 1) % len(order)][3]
        m = len(t) // 3
        e = t[: len(t) - m] + n[:m]
        want[(None if none else i, len(t), hashlib.sha256(e.encode()).hexdigest(), round(plain_likeness(t.encode(), e.encode()), 9), round(plain_likeness(t.encode(), n.encode()), 9))] += 1
    assert Counter((x.doc_id, x.n_chars, x.edited_sha256, round(x.near_edited, 9), round(x.near_next, 9)) for x in got) == want


def test_range_lookup(spark):
    for n in (0, 1, 2, 3, 10, 30):
        cuts = sorted(random.Random(n).sample(range(-50, 50), n))
        got = spark.range(-60, 60).select("id", fingerprint.bucket_of(fingerprint.F.col("id"), cuts).alias("b")).collect()
        assert all(x.b == sum(c <= x.id for c in cuts) for x in got)


def test_fingerprint_of_one_document(spark):
    x = fingerprint.fingerprints(frame(spark, [(5, prose(0, 40))])).collect()
    assert len(x) == 1 and x[0].near_next == 1


# ---- op4 ----


def test_viterbi_and_sums_against_enumeration():
    r = np.random.default_rng(3)
    for n in (1, 2, 5, 9):
        s, pairs = r.standard_normal(n) * 2, r.standard_normal((2, 2))
        field = html_extract.Field({}, pairs)
        worth = {y: sum(v for v, k in zip(s, y, strict=True) if k) + sum(pairs[a][b] for a, b in zip(y, y[1:], strict=False)) for y in itertools.product((0, 1), repeat=n)}
        assert tuple(map(int, field.viterbi(s.tolist()))) == max(worth, key=worth.get)
        whole, p, joint = html_extract.forward_backward(np.array([[*s, 0.0]]), np.array([[True] * n + [False]]), pairs)
        total = sum(map(math.exp, worth.values()))
        assert math.isclose(whole[0], math.log(total), rel_tol=1e-9)
        for k in range(n):
            assert math.isclose(p[0, k], sum(math.exp(w) for y, w in worth.items() if y[k]) / total, rel_tol=1e-9)
        assert n == 1 or math.isclose(joint[0, 0, 1, 0], sum(math.exp(w) for y, w in worth.items() if y[:2] == (1, 0)) / total, rel_tol=1e-9)


def test_layouts():
    field, true, extra, lost = html_extract.trained(), 0, 0, 0
    for page, want in LAYOUTS:
        found = html_extract.blocks(page)
        assert set(want) <= {b.text for b in found}
        for b, keep in zip(found, field.decode(found), strict=True):
            good = b.text in want
            true, extra, lost = true + (good and keep), extra + (keep and not good), lost + (good and not keep)
    assert 2 * true / (2 * true + extra + lost) >= 0.9


@pytest.mark.parametrize(
    "page,want",
    [
        ("<head><body><p>Text one is here, and it goes on.</p>", "Text one is here, and it goes on."),
        ('<head><script>var a="<!--";</script></head><body><p>Text one is here, and it goes on.</p>', "Text one is here, and it goes on."),
        ('<p class="a"">He said "hello" to them all, and left.</p><p>Then "more" words came, as ever.</p>', 'He said "hello" to them all, and left. Then "more" words came, as ever.'),
        ("<p title='it's'>It's here that the text begins, they said.</p>", "It's here that the text begins, they said."),
        ("<p>One word, and two.<svg><svg></svg>junk</svg> Three more words.</p>", "One word, and two. Three more words."),
        ("<article><p>Press the <button>red</button> button now, please.</p></article>", "Press the red button now, please."),
        ("<article><p>Pick <select><option>a<option>b</select> one, then carry on.</p></article>", "Pick one, then carry on."),
        ("<article><p>A<!-- > --!>B, and <!-->C<!---> follow here.</p></article>", "AB, and C follow here."),
        ("<article><p data-x=a>b 1 < 2 & 3 &gt; 2 &amp;c, they say.</p></article>", "b 1 < 2 & 3 > 2 &c, they say."),
        ("<article><p>One is here, of course.<textarea><p>gone</textarea><style>p</p></style></p><p>Two is there, too.</p></article>", "One is here, of course. Two is there, too."),
    ],
)
def test_pages(page, want):
    assert html_extract.main_text(page, html_extract.trained()) == want


def test_long_and_odd_pages(spark):
    article = "<article><h1>Head line</h1>" + "".join(f"<p>Sentence {k} is here, and ends.</p>" for k in range(20000)) + "</article>"
    rows = [(1, "u", article, "x"), (None, None, None, "x"), (1, "u", "<p>", "x"), (1, "u", "<p>", "x"), (2, "v", "<div>" * 3000 + "Deep text, found." + "<" * 3000, "x"), (3, "w", "=" * 100000 + "<a " + "= " * 50000, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(2)
    got = html_extract.extract(df).collect()
    assert len(got) == len(rows)
    assert [x.text for x in got if x.n_chars > 200000] == ["Head line " + " ".join(f"Sentence {k} is here, and ends." for k in range(20000))]
    assert Counter((x.page_id, x.url) for x in got) == Counter((i, u) for i, u, *_ in rows)
    assert html_extract.extract(df.where("false")).count() == 0


# ---- op5 ----


def test_words_that_fool_polynomials():
    """Thue-Morse words and their complements have equal polynomial hashes modulo 2**64."""
    word = "a"
    while len(word) < 4096:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    for n in (128, 200, 1024, 2048, 4096):
        data = np.frombuffer((word[:n] + other[:n]).encode(), np.uint8)
        a, b = shingles.range_hashes(data, np.array([0, n]), np.array([n, 2 * n]))
        assert a != b


def test_range_hashes_are_of_the_bytes():
    r = random.Random(1)
    raw = bytes(r.choice(b"ab") for _ in range(3000))
    start = np.array([r.randrange(2900) for _ in range(3000)])
    stop = start + np.array([r.choice([1, 2, 3, 7, 8, 9, 20]) for _ in range(3000)])
    by = defaultdict(set)
    for h, a, b in zip(shingles.range_hashes(np.frombuffer(raw, np.uint8), start, stop).tolist(), start.tolist(), stop.tolist(), strict=True):
        by[raw[a:b]].add(h)
    assert all(len(x) == 1 for x in by.values()) and len({h for x in by.values() for h in x}) == len(by)


def test_bitmaps_lose_no_pair():
    r = np.random.default_rng(5)
    members, sets = [], {}
    for k in range(60):
        n = int(r.integers(1, 300))
        own = r.integers(0, 1 << 62, n).astype(np.uint64)
        if k % 2:
            before = sets[k - 1]
            own = np.concatenate([before[: int(len(before) * r.uniform(0.75, 1))], own[: len(before) // 20]])
        sets[k] = np.unique(own)
        members.append((k, k % 3 % 2, len(sets[k]), ngram_join.bitmap(sets[k])))
    for cross in (False, True):
        links, head = ngram_join.possible(members, 80, cross), list(range(60))
        for a, b in links:
            head = [head[b] if h == head[a] else h for h in head]
        for a, b in itertools.combinations(range(60), 2):
            both = len(np.intersect1d(sets[a], sets[b]))
            if 100 * both >= 80 * len(np.union1d(sets[a], sets[b])) and not (cross and members[a][1] == members[b][1]):
                assert head[a] == head[b]
    assert len({head[k] for k in range(60)}) > 1


def test_join_with_null_and_repeated_ids(spark):
    rows = [(None, prose(0), 1), (4, prose(2), 2), (None, prose(500), 3), (None, prose(500), 3), (6, prose(900), 4), (6, prose(1500), 5), (5, prose(1502), 6), (9, "", 7), (None, None, 8), (8, prose(904), 9), (8, prose(904), 9)]
    got = Counter((x.doc_id, x.n_shingles, x.component_id) for x in ngram_join.ngram_components(frame(spark, rows, ", sign long")).collect())
    # a set whose documents have no id links with nothing; texts of id 6 share its links
    want = Counter([(None, 96, None), (4, 96, 4), (None, 96, None), (None, 96, None), (6, 96, 5), (6, 96, 5), (5, 96, 5), (9, 0, 9), (None, 0, None), (8, 96, 5), (8, 96, 5)])
    assert got == want


# ---- op6, op8, op9 ----


def test_tokens_with_null_and_repeated_ids(spark):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    rows = [(None, "one two"), (None, None), (3, "é" * 40000), (3, ""), (3, "x")]
    core = bpe.Bpe(path, P.PATTERN).core
    got = Counter((x.doc_id, x.n_tokens, x.decoded_sha256) for x in bpe.encode_documents(frame(spark, rows), path, P.PATTERN).collect())
    assert got == Counter((i, len(core.encode_ordinary(t or "")), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
    assert bpe.encode_documents(frame(spark, rows).where("false"), path, P.PATTERN).count() == 0
    packed = packing.pack_documents(frame(spark, rows)).collect()
    assert Counter((x.doc_id, x.doc_tokens) for x in packed if x.start == 0)[(None, 1)] == 1 and sum(x.start == 0 for x in packed) == 5
    assert {x.ids_crc32 for x in packed if x.doc_tokens == 1} == {zlib.crc32(b"\0\0\0\0")}


def test_counts_by_real_tokenizers(spark):
    paths = {v: P.path(v) for v in token_counts.VERSIONS}
    rows = [(1, "The cat, it's 12 o'clock.", "en", "s"), (1, "été — Straße 日本語", "fr", None), (None, None, None, "s"), (2, "", "en", "s"), (3, "ab " * 40000, "en", "s")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, source string, tokens long")
    got = Counter(tuple(x) for x in token_counts.counted(df, paths, P.PATTERN).collect())
    cores = {v: bpe.Bpe(p, P.PATTERN).core for v, p in paths.items()}
    assert got == Counter((i, s, lang, v, len(c.encode_ordinary(t or ""))) for i, t, lang, s in rows for v, c in cores.items())


@pytest.mark.skipif(not TABLES.exists(), reason="needs the tables")
def test_rollups_of_the_query(spark):
    d = f"{TABLES}/sf0.001"
    cores = {v: bpe.Bpe(P.path(v), P.PATTERN).core for v in token_counts.VERSIONS}
    rated = defaultdict(list)
    for x in spark.read.parquet(f"{d}/labels.parquet").collect():
        rated[x.doc_id].append((x.quality, x.toxic))
    want = defaultdict(lambda: [0, 0])
    for x in spark.read.parquet(f"{d}/documents.parquet").collect():
        if x.doc_id in rated and min(q for q, _ in rated[x.doc_id]) == 0:
            continue
        toxic = x.doc_id in rated and max(t for _, t in rated[x.doc_id]) == 1
        for v, c in cores.items():
            own = want[x.source, x.lang, v.removesuffix(".tiktoken")]
            own[0] += 1
            own[1] += 0 if toxic else len(c.encode_ordinary(x.text or ""))
    got = {(x.source, x.lang, x.tokenizer): [x.docs, x.tokens] for x in token_counts.op8_delta_rollups(spark, d).collect()}
    assert got == {k: v for k, v in want.items() if any(v)}


def change(spark, tokens):
    return spark.createDataFrame([("s", "en", "v", "insert", tokens, None)], "source string, lang string, tokenizer string, op string, tokens long, old_tokens long")


def test_one_of_two_writers_commits(spark, tmp_path):
    ledgers = [token_counts.Ledger(spark, f"file://{tmp_path}/ledger") for _ in range(4)]
    done: list[tuple[int, bool]] = []
    workers = [threading.Thread(target=lambda k=k: done.append((k, ledgers[k].apply("1", change(spark, 10 + k))))) for k in range(4)]
    for w in workers:
        w.start()
    for w in workers:
        w.join()
    winners = [k for k, won in done if won]
    assert len(done) == 4 and len(winners) == 1
    assert [(x.docs, x.tokens) for x in ledgers[0].totals().collect()] == [(1, 10 + winners[0])]
    # a late second writer that missed the commit cannot replace it
    assert not ledgers[1]._publish("1", "late")
    assert [x.tokens for x in ledgers[2].totals().collect()] == [10 + winners[0]]


def test_broken_off_commit(spark, tmp_path):
    ledger = token_counts.Ledger(spark, f"file://{tmp_path}/ledger")
    token_counts.deltas(change(spark, 5)).write.parquet(f"file://{tmp_path}/ledger/deltas/1/broken")
    (tmp_path / "ledger/commits").mkdir()
    (tmp_path / "ledger/commits/.draft").write_text("broken")
    assert ledger.totals().count() == 0 and ledger.apply("1", change(spark, 7))
    assert ledger.apply("2", change(spark, 1).where("false")) and not ledger.apply("2", change(spark, 9))
    assert [(x.docs, x.tokens) for x in ledger.totals().collect()] == [(1, 7)]


# ---- op7 ----


def test_suffix_array():
    r = np.random.default_rng(2)
    data = r.integers(97, 99, 400).astype(np.uint8)
    data[50] = 0
    starts = r.permutation(391)
    order, new, suffixes = substring_dedup.suffix_array(data, starts, 10)
    raw = data.tobytes()
    texts = [raw[s : s + 10] for s in starts.tolist()]
    assert order.tolist() == sorted(range(len(texts)), key=lambda k: texts[k])
    ranked = [texts[k] for k in order.tolist()]
    assert new.tolist() == [True] + [a != b for a, b in zip(ranked, ranked[1:], strict=False)]
    assert suffixes.tobytes() == b"".join(texts)


def test_repeats_across_segments(spark):
    g = np.random.default_rng(9)
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz ", np.uint8)
    long = bytearray(letters[g.integers(0, 27, substring_dedup.SEGMENT + 30_000)].tobytes())
    passage = bytes(letters[g.integers(0, 27, 300)])
    at = substring_dedup.SEGMENT - 150
    long[at : at + 300] = passage
    rows = [(1, "start " + passage.decode() + " end"), (2, long.decode())]
    got = {x.doc_id: x for x in substring_dedup.remove_repeats(frame(spark, rows)).collect()}
    runs = got[2].runs
    assert got[1].runs == [] and len(runs) == 2 and runs[0] <= at and runs[1] >= at + 300 and runs[1] - runs[0] < 304
    assert bytes(got[2].kept_bytes) == bytes(long[: runs[0]] + long[runs[1] :])


def test_repeats_with_clashing_columns_and_a_hot_passage(spark):
    r = random.Random(3)
    hot = prose(0, 40)
    rows = [(r.choice([None, 1, 2, k]), " ".join(r.choice(WORDS) for _ in range(9)) + " " + hot + " " + str(k), "own", "kept", "r") for k in range(120)]
    df = frame(spark, rows, ", n_bytes string, key string, runs string")
    got = substring_dedup.remove_repeats(df)
    assert got.columns == ["doc_id", "text", "n_bytes", "key", "runs", "kept_bytes"]
    assert {x.key for x in got.collect()} == {"kept"}
    left = substring_dedup.without_repeats(df)
    assert left.columns == df.columns and {(x.n_bytes, x.key, x.runs) for x in left.collect()} == {("own", "kept", "r")}
    assert sum(hot in x.text for x in left.collect()) == 1 and left.count() == 120
    # in the order of ids, null last, and of the text's hash
    marks = {t: spark.sql("select xxhash64(:t)", args={"t": t}).first()[0] for _, t, *_ in rows}
    seen, want = set(), Counter()
    for i, t in sorted(((i, t) for i, t, *_ in rows), key=lambda x: (x[0] is None, x[0] or 0, marks[x[1]])):
        b, gone = t.encode(), set()
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                gone.update(range(k, k + 100))
            seen.add(b[k : k + 100])
        want[(i, bytes(x for k, x in enumerate(b) if k not in gone).decode())] += 1
    assert Counter((x.doc_id, x.text) for x in left.collect()) == want
    nulls = frame(spark, [(1, None, "a"), (2, "", "b")], ", found string")
    assert Counter(tuple(x) for x in substring_dedup.without_repeats(nulls).collect()) == Counter([(1, None, "a"), (2, "", "b")])
    assert substring_dedup.without_repeats(df.where("false")).count() == 0


# ---- op10 ----


def test_gradient_against_differences():
    r = np.random.default_rng(7)
    s, t, g = r.standard_normal(9), np.array([-0.7, 0.1, 1.2]), r.integers(0, 4, 9)

    def like(s, t):
        total = 0.0
        for x, k in zip(s, g, strict=True):
            tails = [1.0, *(1 / (1 + math.exp(c - x)) for c in t), 0.0]
            total += math.log(tails[k] - tails[k + 1])
        return total / len(s)

    value, ds, dt = quality.gradient(s, t, g)
    assert math.isclose(value, like(s, t), rel_tol=1e-9)
    for k in range(9):
        e = np.eye(9)[k] * 1e-6
        assert math.isclose(ds[k], (like(s + e, t) - like(s - e, t)) / 2e-6, rel_tol=1e-4, abs_tol=1e-9)
    for k in range(3):
        e = np.eye(3)[k] * 1e-6
        assert math.isclose(dt[k], (like(s, t + e) - like(s, t - e)) / 2e-6, rel_tol=1e-4, abs_tol=1e-9)


def test_quality_without_ratings_and_with_clashes(spark):
    rows = [(None, "one two", 0.5), (1, None, 0.5), (1, "", 0.5), (2, "three", 0.5)]
    df = spark.createDataFrame([(*r, "s", 9.0) for r in rows], "doc_id long, text string, p_ge_2 double, selected string, expected_grade double")
    none = quality.train(df, spark.createDataFrame([], "doc_id long, grade int"), 2)
    assert quality.selected_rows(df, none).collect() == df.collect()
    got = quality.score(df, none)
    assert got.columns == ["doc_id", "text", "p_ge_1", "p_ge_2", "expected_grade", "selected"]
    assert all(x.selected and abs(x.p_ge_2 - 1 / 3) < 1e-9 for x in got.collect())
    assert quality.score(df.where("false"), none).count() == 0 and quality.selected_rows(df.where("false"), none).count() == 0
    ratings = spark.createDataFrame([(2, 2), (None, 1)], "doc_id long, grade int")
    assert quality.selected_rows(df, quality.train(df, ratings, 2)).count() <= 4


@pytest.mark.skipif(not TABLES.exists(), reason="needs the tables")
def test_quality_on_held_out_ratings(spark):
    """Fitted on a half of the rated documents of sf0.1; figures of the other half."""
    docs = spark.read.parquet(f"{TABLES}/sf0.1/documents.parquet").select("doc_id", "text")
    rated = quality.grades(spark.read.parquet(f"{TABLES}/sf0.1/labels.parquet"))
    model = quality.train(docs, rated.where("xxhash64(doc_id) % 2 = 0"), 2)
    got = quality.score(docs, model, keep_text=False).join(rated.where("xxhash64(doc_id) % 2 <> 0"), "doc_id").toPandas()
    share = got.groupby("grade").selected.mean()
    assert share[2] > 0.97 and share[1] < 0.25 and share[0] < 0.45


def test_features_of_null_and_empty_texts():
    index, offsets = quality.features(pa.array([None, "", "a"]))
    assert index[offsets[0] : offsets[1]].tolist() == index[offsets[1] : offsets[2]].tolist()
