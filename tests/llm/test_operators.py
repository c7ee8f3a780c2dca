"""Corpus operators on small tables with every awkward case, against brute force."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import automata, bpe, common, components, fingerprint, gif, jaccard, lines, mixing, private, queries, suffix_array, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size string"
rng = random.Random(3)
VOCAB = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(2, 7))) for _ in range(300)]


def prose(n):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


BASE = [prose(120) for _ in range(8)]
PASSAGE = prose(60)
TEXTS = [
    *BASE, BASE[0], BASE[0], BASE[1].replace(" ", "  ", 1), BASE[2] + " tail", " ".join(BASE[3].split()[3:]), None, "", " \n\t", "one", "one two three four", "ONE two Three four",
    f"{prose(30)}\n{PASSAGE}\n{prose(30)}", f"{PASSAGE}\n\n{prose(10)}", f"{prose(5)} {PASSAGE}", "a " * 200, "ab" * 300, "x" * 5000, "line\n" * 5, "😀 naïve İ\x00\x01 text", prose(3000),
    "mail me at joe@x.org or 10.0.0.1 and 4111 1111 1111 1111, +1 (212) 555-0100.", "bad 300.1.1.1 4111111111111112 +12 a@b",
]
ROWS = [(i, t, "en", ["a", "b", None][i % 3], len(t or ""), 0.1, "s") for i, t in enumerate(TEXTS)]
ROWS += [ROWS[0], (None, BASE[4], None, None, None, None, None), (5, "another text with the id five", "en", "a", 1, 0.1, "s")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def clean(spark):
    """Distinct ids only."""
    return spark.createDataFrame(ROWS[: len(TEXTS)], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def sha(b):
    return hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


def test_empty_tables_give_empty_tables(empty):
    for df in (lines.dedup(empty), gif.digest(empty), bpe.digest(empty, *queries.rank_file()), toxicity.score(empty, toxicity.Model({}, -5.0)), suffix_array.dedup(empty), automata.dedup(empty), mixing.mix(empty), private.find(empty), jaccard.classes(empty), fingerprint.digest(empty)):
        assert df.count() == 0


def test_line_dedup(clean):
    k, seen, kept = lines.SHINGLE, [], {}
    for i, t in enumerate(TEXTS):
        keep = []
        for line in (t or "").split("\n"):
            s = {line[j : j + k] for j in range(max(1, len(line) - k + 1))}
            if not line.strip(" \t\r\f\v"):
                keep.append(line)
                continue
            if not any(100 * len(s & o) >= 80 * len(s | o) for o in seen):
                keep.append(line)
            seen.append(s)
        kept[i] = "\n".join(keep)
    got = {r.doc_id: r for r in lines.dedup(clean).collect()}
    assert got[13].text is None and got[13].n_lines == 0 and got[0].size == "s"
    assert {i: r.text or "" for i, r in got.items()} == kept


def test_line_dedup_takes_repeated_rows_as_one(docs):
    got = lines.dedup(docs).filter("doc_id = 0").collect()
    assert len(got) == 2 and {r.text for r in got} == {BASE[0]}


def test_line_dedup_finds_pairs_in_bands_of_one_template(spark):
    r, k = random.Random(5), lines.SHINGLE
    template = "".join(r.choice("abcdefghijklmnop ") for _ in range(100))
    tails = ["".join(chr(r.randrange(0x4E00, 0x9000)) for _ in range(14)) for _ in range(150)]
    rows = [template + t for t in tails] + [template + t[:7] + "_" + t[8:] for t in tails]
    sets = [{t[j : j + k] for j in range(len(t) - k + 1)} for t in rows]
    like = lambda x, y: len(x & y) / len(x | y)
    assert all(like(sets[i], sets[j]) >= 0.8 if j - i == 150 else like(sets[i], sets[j]) < 0.8 for j in range(300) for i in range(j))
    got = {x.doc_id: x.n_removed for x in lines.dedup(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert got == {i: int(i >= 150) for i in range(300)}


def test_line_dedup_recall_among_lines_of_a_long_template(spark):
    """800 lines that share 300 characters and 200 near copies of some of them: pairs of the template stay below 0.8."""
    r, k = random.Random(6), lines.SHINGLE
    template = "".join(r.choice("abcdefghijklmnop ") for _ in range(300))
    rows = [template + "".join(chr(r.randrange(0x4E00, 0x9000)) for _ in range(60)) for _ in range(800)]
    copied = r.sample(range(800), 200)
    for i in copied:
        t = list(rows[i])
        for p in r.sample(range(310, 350), 3):
            t[p] = "_"
        rows.append("".join(t))
    sets = [{t[j : j + k] for j in range(len(t) - k + 1)} for t in rows]
    like = lambda x, y: len(x & y) / len(x | y)
    assert all(like(sets[i], sets[800 + n]) >= 0.8 for n, i in enumerate(copied))
    assert max(like(sets[i], sets[j]) for i in range(0, 800, 7) for j in range(i)) < 0.8
    got = {x.doc_id: x.n_removed for x in lines.dedup(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert sum(got[i] for i in range(800)) == 0 and sum(got[800 + n] for n in range(200)) >= 198


def test_line_dedup_tests_few_pairs_without_further_turns(spark, monkeypatch):
    turns, before = [], lines.candidates
    monkeypatch.setattr(lines, "candidates", lambda *a: turns.append(a[2]) or before(*a))
    r = random.Random(8)
    rows = ["".join(r.choice("abcdefgh ") for _ in range(80)) for _ in range(20)]
    rows += [t + "_" for t in rows]
    got = {x.doc_id: x.n_removed for x in lines.dedup(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert got == {i: int(i >= 20) for i in range(40)} and turns == [0]


def test_line_dedup_takes_only_large_bands_to_further_turns(spark, monkeypatch):
    """Lines of one template stay open for further turns; unlinked pairs that share a band, two lines each, don't."""
    seen, before = {}, lines.candidates
    monkeypatch.setattr(lines, "candidates", lambda *a: seen.update({a[2]: {x.lid for x in a[0].select("lid").collect()}}) or before(*a))
    r = random.Random(11)
    text = lambda n: "".join(chr(r.randrange(0x4E00, 0x9000)) for _ in range(n))
    template, pairs = text(100), []
    for _ in range(20):
        t = text(100)
        pairs += [t + text(20), t + text(20)]  # 94 of 134 shingles
    tails = [text(14) for _ in range(100)]
    rows = [*pairs, *(template + t for t in tails), *(template + t[:7] + "_" + t[8:] for t in tails)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert {x.doc_id: x.n_removed for x in lines.dedup(docs).collect()} == {i: int(i >= 140) for i in range(240)}
    apart = {x.lid for x in docs.filter("doc_id < 40").select(F.xxhash64("text").alias("lid")).collect()}
    assert len(seen) > 1 and seen[0] & apart and not any(seen[turn] & apart for turn in seen if turn)


def test_line_dedup_costs_no_square_of_a_lines_length(spark):
    """Two near copies of 400,000 characters: cutting each shingle from a copy of the whole line costs the square of its length."""
    r = random.Random(9)
    line = "".join(r.choice("abcdefghijklmnop ") for _ in range(400_000))
    took = []
    for n in (100, 400_000):
        rows = spark.createDataFrame([(0, line[:n]), (1, line[:n] + "_")], "doc_id long, text string")
        began = time.monotonic()
        assert {x.doc_id: x.n_removed for x in lines.dedup(rows).collect()} == {0: 0, 1: 1}
        took.append(time.monotonic() - began)
    assert took[1] < took[0] + 15


def test_line_dedup_leaves_out_lines_that_share_a_band_by_chance(spark):
    near, far = (0x0102030405FF, 1, 2, 3), (0x010203040506, -2, -3, -4)
    rows = [(1, 10, *near), (2, 10, *far), (3, 11, *near), (4, 11, 0x0102030405FE, 1, 2, 3)] + [(100 + i, 12, *[(i * 7919 + k) * 0x9E3779B97F4A % 2**48 for k in range(4)]) for i in range(lines.SMALL + 1)]
    marked = spark.createDataFrame(rows, "lid long, band long, s0 long, s1 long, s2 long, s3 long").withColumn("component", F.col("lid"))
    assert {x.lid for x in lines.promising(marked).collect()} == {3, 4} | {100 + i for i in range(lines.SMALL + 1)}


def test_line_dedup_signatures_keep_pairs_at_the_threshold(spark):
    r, k, rows = random.Random(10), lines.SHINGLE, []
    for i in range(400):
        t = [chr(r.randrange(0x4E00, 0x9000)) for _ in range(r.choice((12, 30, 60, 150)))]
        s = {"".join(t[j : j + k]) for j in range(len(t) - k + 1)}
        while True:  # as many characters more as the threshold allows
            more = t + [chr(r.randrange(0x4E00, 0x9000))]
            if 100 * len(s) < 80 * (len(more) - k + 1):
                break
            t = more
        rows += [(2 * i, "".join(t[: len(s) + k - 1])), (2 * i + 1, "".join(t))]
    signed = lines.signatures(spark.createDataFrame(rows, "lid long, line string").repartition("lid"))
    x, y = (signed.select(F.shiftright("lid", 1).alias("i"), (F.col("lid") % 2).alias("o"), *(F.col(c).alias(f"{c}_{side}") for c in ("bands", *(f"s{p}" for p in range(4))))).filter(f"o = {o}").drop("o") for o, side in enumerate("xy"))
    unlike = lines._unlike(*(lambda c, side=side: F.col(f"{c}_{side}") for side in "xy"))
    got = x.join(y, "i").select(F.size(F.array_intersect(F.array_compact("bands_x"), F.array_compact("bands_y"))).alias("shared"), unlike.alias("unlike")).collect()
    assert sum(g.shared > 0 for g in got) >= 380 and max(g.unlike for g in got if g.shared) <= lines.UNLIKE


def test_a_stored_table_leaves_no_shuffle_files(spark):
    files = lambda: set(re.findall(r"shuffle_\d+_\d+", spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ")))
    before = files()
    stored = common.store(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "test")
    assert not files() - before and stored.count() == 7
    common.discard(stored)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 7), (200, 201), (300, 300), (-5, 202), (202, 200)]
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(41)}, 100: 0, 200: -5, 201: -5, 202: -5, -5: -5}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_few_edges_take_few_tasks(spark, monkeypatch):
    r = random.Random(4)
    edges = spark.createDataFrame([(r.randrange(-300, 300), r.randrange(-300, 300)) for _ in range(350)], "a long, b long")
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "40"}
    before = {k: spark.conf.get(k) for k in conf}
    spark.sparkContext.setJobGroup("few edges", "few edges")
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        few = sorted(map(tuple, components.components(edges).collect()))
    finally:
        spark.sparkContext.setJobGroup("", "")
        for k, v in before.items():
            spark.conf.set(k, v)
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("few edges") for s in tracker.getJobInfo(j).stageIds]
    assert 0 < sum(s.numCompletedTasks for s in stages if s) < 400
    monkeypatch.setattr(components, "SMALL", 0)
    assert sorted(map(tuple, components.components(edges).collect())) == few


def test_lzw_round_trips():
    for bits in (2, 4, 8):
        for n in (0, 1, 2, 3, 255, 4097, 30_000):
            a = np.random.default_rng(n).integers(0, 1 << bits, n).astype(np.uint8)
            a[: n // 2] = 1
            assert gif.lzw_decode(gif.lzw_encode(a.tobytes(), bits), bits, n).tobytes() == a.tobytes()


def test_lzw_goes_on_with_a_full_table():
    codes, n = [256, *([65, 66] * 2500), 257], 5000  # literals only, no clear: widths grow to 12 bits and stay
    width = [9, *gif._widths(8, 5001).tolist()]
    value, at = 0, 0
    for c, w in zip(codes, width):
        value |= c << at
        at += w
    assert gif.lzw_decode(value.to_bytes(at // 8 + 1, "little"), 8, n).tolist() == [65, 66] * 2500


def test_gif_frames_disposal_transparency():
    p = np.array([[0, 0, 0], [255, 0, 0], [0, 255, 0], [0, 0, 255]], np.uint8)
    full = lambda v: np.full((4, 4), v)
    data = gif.encode(
        [
            {"indices": full(1), "delay_cs": 5},
            {"indices": np.array([[2, 0], [0, 2]]), "left": 1, "top": 1, "transparent": 0, "disposal": 3},
            {"indices": np.full((2, 2), 3), "left": 2, "top": 2, "disposal": 2},
            {"indices": np.full((1, 1), 1), "palette": np.array([[9, 9, 9], [8, 8, 8]]), "interlaced": True},
        ],
        4, 4, p,
    )
    w, h, f = gif.decode(data)
    assert (w, h, [x.delay_cs for x in f]) == (4, 4, [5, 0, 0, 0])
    assert f[1].canvas[1, 1].tolist() == [0, 255, 0, 255] and f[1].canvas[1, 2].tolist() == [255, 0, 0, 255]
    assert f[2].canvas[1, 1].tolist() == [255, 0, 0, 255] and f[2].canvas[3, 3].tolist() == [0, 0, 255, 255]
    assert f[3].canvas[3, 3].tolist() == [0, 0, 0, 0] and f[3].canvas[0, 0].tolist() == [8, 8, 8, 255]
    assert gif.histogram(f[3].canvas).sum() == 12
    for damaged in (b"", b"GIF89a", data[: len(data) // 2], b"PNG" + data):
        with pytest.raises(ValueError):
            gif.decode(damaged)


def test_gif_digest(docs):
    for r, text in zip(docs.sparkSession.createDataFrame([(0, None), (1, "ab"), (2, "z" * 200_000)], "doc_id long, text string").transform(gif.digest).orderBy("doc_id").collect(), (b"", b"ab", b"z" * 200_000)):
        p = text + b"\xff" * (max(1, -(-len(text) // 576)) * 576 - len(text))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(text), len(p), sha(p), zlib.crc32(p[-32:]))
    assert gif.digest(docs).count() == len(ROWS)
    f = gif.frames(gif.to_gif(docs.limit(3))).collect()
    assert all(len(r.histogram) == 64 and sum(r.histogram) >= r.width * r.height for r in f)


def test_bpe_equals_the_whole_text_encoder(docs):
    path, pattern = queries.rank_file()
    tool = bpe.codec(open(path, "rb").read(), pattern)
    long = " ".join(prose(40_000).split()) + "\n\n  '" + "é" * 1000
    assert len(bpe.parts(long)) > 1 and tool.encode(long) == tool.encoding.encode_ordinary(long)
    got = bpe.decode(bpe.encode(docs, path, pattern), path, pattern).collect()
    assert all(bytes(r.decoded).decode() == (r.text or "") for r in got) and len(got) == len(ROWS)
    assert all(r.decoded_sha256 == sha(t or "") for r in bpe.digest(docs, path, pattern).collect() for t in ([TEXTS[r.doc_id]] if r.doc_id not in (None, 5) else []))


def test_toxicity_learns_sentences_from_document_labels(spark, docs):
    make = lambda bad: ". ".join(prose(8) + (" zork vile" if bad and k == 2 else "") for k in range(6))
    y = [i % 4 == 0 for i in range(400)]
    texts = [make(b) for b in y]
    rows = [(i, t) for i, t in enumerate(texts[:300])] + [(0, texts[0]), (1000, None), (1001, ""), (None, "zork")]
    labels = [(i, int(b)) for i, b in enumerate(y[:300])] + [(0, 1), (1000, 0), (1001, None), (9999, 1), (None, 1)]
    frames = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(*frames)
    scorer = toxicity.Scorer(model)
    got = [scorer(t) for t in texts[300:]]
    assert [s >= 0.5 for s, *_ in got] == y[300:]
    assert all("zork" in t[a:b] for t, (s, a, b, _) in zip(texts[300:], got) if s >= 0.5)
    assert scorer(None)[0] == scorer("")[0] == 0
    assert toxicity.fit(*(f.repartition(3) for f in frames)) == model
    for none in (frames[1].filter("toxic = 0"), frames[1].limit(0)):
        assert toxicity.fit(frames[0], none).weights == {}
    again = toxicity.score(docs.withColumn("worst_start", F.lit("x")), model)
    assert again.columns == [*docs.columns[:-2], "size", "score", "worst_start", "worst_end", "worst_score"] and again.count() == len(ROWS)
    long = "plain words here. " * 100_000 + "zork vile."
    assert scorer(long)[1:3] == (len(long) - 11, len(long))


def test_toxicity_weights_equal_those_of_repeated_sentences():
    """Sentences of one feature set, counted, act as themselves."""
    y = np.array([1.0, 0.0, 1.0, 0.0])
    several = [([1, 1, 0], [0, 0], [1, 1, 1]), ([0, 0], [], [1, 1]), ([1], [0], [1]), ([0], [], [1])]
    counted = [([1, 0], [0], [2, 1]), ([0], [], [2]), ([1], [0], [1]), ([0], [], [1])]
    a, b = (toxicity.optimise(["f"], y, x) for x in (several, counted))
    assert abs(a.weights["f"] - b.weights["f"]) < 1e-6 and abs(a.bias - b.bias) < 1e-6


def test_suffix_array(clean, docs):
    first = {}
    for i, t in enumerate(TEXTS):
        b = (t or "").encode()
        for k in range(len(b) - 49):
            first.setdefault(b[k : k + 50], i)
    for r in suffix_array.dedup(clean, keep=True).collect():
        b = (TEXTS[r.doc_id] or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < r.doc_id:
                gone[k : k + 50] = True
        assert (r.n_bytes, r.n_removed, bytes(r.kept)) == (len(b), gone.sum(), np.frombuffer(b, np.uint8)[~gone].tobytes())
    assert suffix_array.dedup(docs).count() == len(ROWS)


def test_suffix_array_equals_doubling_of_all_positions(clean):
    first = {}
    for i, t in enumerate(TEXTS):
        b = (t or "").encode()
        for k in range(len(b) - 49):
            first.setdefault(b[k : k + 50], []).append((i, k))
    want = sorted(x for at in first.values() if len(at) > 1 for x in at)
    assert sorted(map(tuple, suffix_array.doubled(clean.select("doc_id", "text")).collect())) == want


def test_suffix_array_of_runs_and_periods(spark):
    """Positions that tie by the thousand, in one document, in later ones, at texts' ends."""
    texts = ["z" * 30_000, "a" + "z" * 70 + "b", "z" * 49, "xyz" * 5000, "q" + "xyz" * 30, "z" * 26_000 + "!" + "z" * 60 + "?" + "z" * 51, "ab" * 26 + "c" + "ab" * 40]
    first = {}
    for i, t in enumerate(texts):
        for k in range(len(t) - 49):
            first.setdefault(t[k : k + 50], i)
    got = {r.doc_id: r for r in suffix_array.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), keep=True).collect()}
    for i, t in enumerate(texts):
        gone = bytearray(len(t))
        for k in range(len(t) - 49):
            if first[t[k : k + 50]] < i:
                gone[k : k + 50] = b"\x01" * 50
        assert bytes(got[i].kept).decode() == "".join(c for c, g in zip(t, gone) if not g)


def test_substring_dedup(clean, docs):
    seen = Counter(tuple(w[k : k + 35]) for t in TEXTS for w in [words(t)] for k in range(len(w) - 34))
    want = {}
    for i, t in enumerate(TEXTS):
        w, gone = words(t), set()
        for k in range(len(w) - 34):
            if seen[tuple(w[k : k + 35])] > 1:
                gone |= set(range(k, k + 35))
        want[i] = (len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in automata.dedup(clean).collect()} == want
    assert automata.dedup(docs).count() == len(ROWS)


def test_automata_of_any_shards_agree_with_brute_force():
    window = automata.WINDOW
    for seed in range(6):
        r = np.random.default_rng(seed)
        passages = [r.integers(0, 2**60, 50) for _ in range(4)]
        rows = []
        for _ in range(12):
            parts = [r.integers(0, 2**60, r.integers(0, 12)), *(passages[k][r.integers(0, 9) : r.integers(40, 51)] for k in r.integers(0, 4, r.integers(1, 3)))]
            rows.append(np.concatenate([*parts, r.integers(0, 2**60, 5)]).astype(np.uint64))
        rows.append(np.tile(r.integers(0, 2**60, 3), 40).astype(np.uint64))  # windows that overlap themselves
        size = np.array([len(x) for x in rows])
        seen = Counter(x[k : k + window].tobytes() for x in rows for k in range(len(x) - window + 1))
        want = {(d, k + j) for d, x in enumerate(rows) for k in range(len(x) - window + 1) if seen[x[k : k + window].tobytes()] > 1 for j in range(window)}
        for shard in (1, 3, 2000):
            doc, start, end = automata.refine(automata.SPEC, np.ones(len(rows), np.uint64), np.arange(len(rows)), np.zeros(len(rows), int), size, np.zeros(len(rows), bool), np.zeros(len(rows), int), np.concatenate(rows), shard)
            assert {(d, k) for d, a, b in zip(doc.tolist(), start.tolist(), end.tolist()) for k in range(a, b)} == want


def test_substring_dedup_takes_any_ids(clean, spark):
    items = np.random.default_rng(1).integers(0, 2**60, 60).astype(np.uint64)
    other = np.random.default_rng(2).integers(0, 2**60, (2, 20)).astype(np.uint64)
    rows = [np.concatenate([items[:40], other[0]]), np.concatenate([items[:40], other[1]])]
    for ids in ([0, 1], [2**33, 2**34], [2**62, 2**63 - 1], [-5, -(2**63)], [-1, 2**31]):
        for shard in (2000, 1):
            doc, start, end = automata.refine(automata.SPEC, np.ones(2, np.uint64), np.array(ids), np.zeros(2, int), np.full(2, 60), np.zeros(2, bool), np.zeros(2, int), np.concatenate(rows), shard)
            assert {(d, k) for d, a, b in zip(doc.tolist(), start.tolist(), end.tolist()) for k in range(a, b)} == {(d, k) for d in ids for k in range(40)}
    shown = lambda df: sorted((r.n_words, r.n_removed, r.kept_sha256) for r in automata.dedup(df).collect())
    want = shown(clean)
    assert shown(clean.withColumn("doc_id", F.col("doc_id") * 2**34 - 2**36)) == want
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so that numbers run over several partitions
    try:
        assert shown(clean.withColumn("doc_id", F.when(F.col("doc_id") % 3 > 0, F.col("doc_id") % 5))) == want
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_mixing(docs):
    got = mixing.mix(docs).collect()
    assert len(got) == len(ROWS) and all(0 <= r.taken <= 2 * r.size for r in got)
    size, taken, target = Counter(), Counter(), {}
    for r in got:
        size[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert abs(sum(target.values()) - 1.5 * sum(size.values())) < 1e-6
    assert all(target[s] <= 2 * size[s] + 1e-9 and abs(taken[s] - target[s]) <= 3200 for s in size)
    assert sorted(map(str, mixing.mix(docs.repartition(5)).collect())) == sorted(map(str, got))
    kept = mixing.emit(mixing.mix(docs, keep_text=True))
    assert kept.count() == sum(r.copies for r in got)


def test_private(docs):
    r = private.find(docs.filter("doc_id >= 26")).orderBy("doc_id").collect()
    by = {x.doc_id: x for x in r}
    t = TEXTS[28]
    assert by[28].spans == ",".join(f"{k}:{t.index(v)}:{t.index(v) + len(v)}" for k, v in (("email", "joe@x.org"), ("ip", "10.0.0.1"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (212) 555-0100")))
    assert by[29].spans == "" and by[27].n_email == 0


def test_private_discovers_by_context(spark):
    rows = [(i, f"{prose(5)} contact mailbox: user{i}@site.org {prose(3)}") for i in range(12)] + [(99, "contact mailbox: odd@host9 now"), (100, "x odd@host9 y")]
    got = {r.doc_id: r for r in private.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[99].n_discovered == 1 and got[99].spans == "email:17:26" and got[100].n_discovered == 0 and got[3].n_email == 1


def test_private_takes_words_before_across_matches(spark):
    rows = [(i, f"{prose(5)} contact Email1: user{i}@site.org {prose(3)}") for i in range(12)] + [(99, "contact Email1: odd@host9 now"), (100, "x Email1: odd@host9 y")]
    got = {r.doc_id: r for r in private.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[99].spans == "email:16:25" and got[99].n_discovered == 1 and got[100].n_discovered == 0 and got[3].n_email == 1


def test_jaccard(clean, docs):
    def shingles(t):
        w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}

    s = [shingles(t) for t in TEXTS]
    group = list(range(len(s)))
    for i in range(len(s)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= 80 * len(s[i] | s[j]):
                a, b = sorted((group[i], group[j]))
                group = [a if g == b else g for g in group]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.classes(clean).collect()} == {i: (len(s[i]), group[i]) for i in range(len(s))}
    assert jaccard.classes(docs).count() == len(ROWS)
    assert sorted(r.doc_id for r in jaccard.keep_one(clean).collect()) == sorted(set(group))


def test_jaccard_of_one_large_group_of_near_copies(spark, monkeypatch):
    """Copies of one text with 0 to 30 words changed: chains, stars and pairs just below the threshold; a third are equal."""
    r = random.Random(9)
    base = prose(150).split()
    texts = []
    for _ in range(260):
        w = list(base)
        for p in r.sample(range(150), r.choice([0, 1, 2, 3, 4, 5, 6, 8, 12, 30])):
            w[p] = "e" + str(r.randrange(5))
        texts.append(" ".join(w))
    texts += [texts[7]] * 130 + [prose(150) for _ in range(20)]
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in map(str.split, texts)]
    group = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if group[i] != group[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((group[i], group[j]))
                group = [a if g == b else g for g in group]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    want = {i: (len(s), group[i]) for i, s in enumerate(sets)}
    assert len(set(group)) > 20 and {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.classes(df).collect()} == want
    monkeypatch.setattr(jaccard, "TURNS", 0)  # the last block alone finds all links as well
    monkeypatch.setattr(jaccard, "SET_ROW", 16)  # sets in several rows
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.classes(df).collect()} == want


def test_keep_one_keeps_one_row_of_each_component(spark):
    a, b, c = BASE[:3]
    rows = [(7, a), (7, a), (None, a), (None, b), (None, b + " tail"), (8, ""), (None, None), (9, c), (9, a), (10, c), (11, b + " tail b"), (None, BASE[3]), (None, BASE[3] + " tail")]
    got = jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((str(r.doc_id), (r.text or "")[:20]) for r in got) == sorted((str(i), t[:20]) for i, t in ((7, a), (8, ""), (None, ""), (9, c), (11, b), (None, BASE[3])))


def test_fingerprint(docs, clean, monkeypatch):
    ids = list(range(len(TEXTS)))
    for bucket in (1, 1000):
        monkeypatch.setattr(fingerprint.neighbours, "__defaults__", (bucket,))
        got = {r.doc_id: r for r in fingerprint.digest(clean).collect()}
        assert sorted(got) == ids
        for i in ids:
            t, nxt = TEXTS[i] or "", TEXTS[(i + 1) % len(ids)] or ""
            n = len(t) // 4
            e = t[: len(t) - n] + nxt[:n]
            assert (got[i].n_chars, got[i].edited_sha256) == (len(t), sha(e))
            assert got[i].fingerprint == fingerprint.fingerprint(t.encode()) and got[i].near_next == fingerprint.likeness(got[i].fingerprint, fingerprint.fingerprint(nxt.encode()))
        assert fingerprint.digest(docs).count() == len(ROWS)
    # rows without an id come first, in buckets of their own, and every row has one next row
    nulls = docs.unionByName(docs.withColumn("doc_id", F.lit(None).cast("long")))
    got = fingerprint.digest(nulls).collect()
    assert len(got) == 2 * len(ROWS)
    after = Counter(r.edited_sha256 for r in got if r.doc_id is not None and r.doc_id > 5)
    want = {i: TEXTS[i] or "" for i in ids if i > 5}
    edit = lambda t, u: t[: len(t) - len(t) // 4] + u[: len(t) // 4]
    assert all(after[sha(edit(want[i], want[i + 1]))] for i in ids if 5 < i < len(ids) - 1)
    a, b = fingerprint.fingerprint(BASE[0].encode()), fingerprint.fingerprint(BASE[1].encode())
    assert 0 <= fingerprint.likeness(a, b) == fingerprint.likeness(b, a) < fingerprint.likeness(a, a) == 1


def test_fingerprint_of_parts_of_any_length(monkeypatch):
    data = np.random.default_rng(4).integers(0, 256, (2 << 20) + 9).astype(np.uint8).tobytes()
    sizes = [k * fingerprint.PART + n for k in (1, 2) for n in range(-2, 10)]
    got = [fingerprint.counters(data[:n]).tolist() for n in sizes]
    monkeypatch.setattr(fingerprint, "PART", 4 << 20)
    assert got == [fingerprint.counters(data[:n]).tolist() for n in sizes]


def test_pipeline_stages_keep_the_columns(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, d).columns == docs.columns
    got = corpus_pipeline.run(spark, d)
    assert got.columns[:2] == ["doc_id", "n_tokens"] and got.filter(F.col("n_tokens") > 0).count() > 100
