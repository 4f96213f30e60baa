"""BPE, near copies, toxicity, media, search and HTML against brute force, exact round trips and held-out rows."""

import hashlib
import os
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lakesift.llm import bpe, html_template, matroska, simhash, topk, toxicity
from lakesift.llm.common import cut
from lakesift.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOCS)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


TEXTS = [
    "Hello, wörld don't stop",
    "a<|endoftext|>b <|startoftext|> <|ENDOFTEXT|>",
    "  tabs\tand\x0bodd\x1cspaces here there ",
    "",
    None,
    "   \n ",
    "é É Å İstanbul ΣΑΣ 日本語 １２ 3.14 ½ 👩‍👩‍👧",
    "x" * 3000,
    "the cat " * 4000,
    "́ combining first, and ≮ after",
    "it's we'll THEY'RE 'tis 's",
]


@pytest.mark.parametrize("block_bytes", [1, 64, 1 << 20])
def test_bpe(spark, block_bytes):
    rows = list(enumerate(TEXTS)) + [(None, "no id"), (0, TEXTS[0]), (0, TEXTS[0])]
    df = documents(spark, rows).withColumn("ids", F.lit("clash")).repartition(3)
    got = bpe.encode(df, full=True, block_bytes=block_bytes).collect()
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = []
    for i, t in rows:
        ids = plain.encode(t or "", add_special_tokens=False).ids
        text = plain.decode(ids, skip_special_tokens=False)
        expected.append((i, len(ids), sha(" ".join(map(str, ids))), sha(text), ids, text))
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    assert sorted(map(tuple, got), key=key) == sorted(expected, key=key)


def test_decoding_joins_pieces(spark):
    encoded = bpe.encode(documents(spark, list(enumerate(TEXTS))), full=True).persist()
    assert {r["doc_id"]: r["decoded"] for r in bpe.decode(encoded).collect()} == {r["doc_id"]: r["decoded"] for r in encoded.collect()}


def test_decoding_odd_ids(spark):
    rows = [(1, [0, 5, None, -3, 10**9]), (2, []), (3, None), (4, [7])]
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {r["doc_id"]: r["decoded"] for r in bpe.decode(spark.createDataFrame(rows, "doc_id int, ids array<int>")).collect()}
    assert got == {1: f"{plain.id_to_token(0)} {plain.id_to_token(5)}", 2: "", 3: "", 4: plain.id_to_token(7)}


def test_equal_blocks_share_a_number(spark):
    df = documents(spark, [(1, "a b a"), (2, "c")] * 4).repartition(1)
    one, two = (sorted(map(tuple, bpe.encode(d, block_bytes=n).collect())) for d, n in ((df, 1), (df, 1 << 20)))
    assert one == two and len(one) == 8


def test_bpe_shuffles_packed_texts_once(spark):
    df = bpe.encode(documents(spark, [(1, "a b")]))
    df.collect()
    assert "ReusedExchange" in df._jdf.queryExecution().executedPlan().toString()
    assert bpe.encode(documents(spark, [])).count() == 0


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 4]) for k in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints, radius=4):
    root = {i: i for i in range(len(prints))}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def copies():
    rng = np.random.default_rng(0)
    words = [f"w{k}" for k in range(300)]
    rows = []
    for _ in range(12):
        base = list(rng.choice(words, 220))
        for edits in range(5):
            t = list(base)
            for k in rng.integers(0, 220, edits):
                t[k] = "X"
            rows.append(" ".join(t))
    return [*rows, rows[0], rows[0], rows[0].upper(), "", None, " \x0b", "one two", "One\ttwo", "q", " ", "É é"]


def test_simhash(spark):
    texts = copies()
    rng = np.random.default_rng(1)
    ids = rng.permutation(len(texts)).tolist()
    df = documents(spark, list(zip(ids, texts))).withColumn("fp", F.lit("clash")).repartition(4)
    got = {r["doc_id"]: r for r in simhash.near_duplicates(df).collect()}
    prints = [slow_fingerprint(t) for t in texts]
    assert len(got) == len(texts)
    group = slow_components(prints)
    least = {g: min(i for i, h in zip(ids, group) if h == g) for g in set(group)}
    for i, p, g in zip(ids, prints, group):
        assert (got[i]["fp"] & (1 << 64) - 1, got[i]["component_id"]) == (p, least[g])
    assert len(set(least.values())) < len(texts)


def test_simhash_writes_few_files(spark):
    """Files in the checkpoint folder follow rows and cores, not shuffle partitions; results are the same."""
    texts = copies()
    df = documents(spark, list(enumerate(texts))).coalesce(1)
    cut(spark.range(1))
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    files = lambda: sum(name.startswith("part-") for _, _, names in os.walk(folder) for name in names)
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 50)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        before = files()
        got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(df).collect()}
        wrote = files() - before
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert got == dict(enumerate(slow_components([slow_fingerprint(t) for t in texts])))
    assert 0 < wrote < 50


def test_simhash_tiles_find_every_link():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    near = base.copy()
    for _ in range(3):
        near ^= np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)
    fps = np.unique(np.concatenate([base, near]))
    for left, right in ((fps, None), (fps[::2], fps[1::2])):
        a, b = simhash.compare(np.ascontiguousarray(left), None if right is None else np.ascontiguousarray(right))
        both = fps.tolist() if right is None else [*left.tolist(), *right.tolist()]
        root = list(range(len(both)))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for x, y in zip(a.tolist(), b.tolist()):
            root[find(x)] = find(y)
        for i in range(len(both)):
            for j in range(i):
                if (both[i] ^ both[j]).bit_count() <= 4 and (right is None or (i < len(left)) != (j < len(left))):
                    assert find(i) == find(j)
        assert len(a) < len(both)


def test_simhash_odd_tables(spark):
    assert simhash.near_duplicates(documents(spark, [])).count() == 0
    got = simhash.near_duplicates(documents(spark, [(None, "a b c d e"), (None, "a b c d e"), (3, "a b c d e"), (None, "zz")])).collect()
    assert sorted(((r["doc_id"], r["component_id"]) for r in got), key=str) == sorted([(None, 3), (None, 3), (3, 3), (None, None)], key=str)


def test_one_of_each(spark):
    texts = copies()
    df = documents(spark, list(enumerate(texts)) + [(0, texts[0]), (None, "only nulls"), (None, "only nulls")])
    df = df.withColumns({c: F.lit("clash") for c in ("_md5", "row", "id", "digest", "best_id", "root")})
    out = simhash.one_of_each(df)
    assert out.columns == df.columns and out.first()["_md5"] == "clash"
    got = sorted(r["doc_id"] for r in out.collect() if r["doc_id"] is not None)
    assert got == sorted(set(slow_components([slow_fingerprint(t) for t in texts])))
    assert out.where("doc_id is null").count() == 1
    assert simhash.one_of_each(documents(spark, [])).count() == 0


def test_components(spark):
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 200, (120, 2))] + [(k, k + 1) for k in range(300, 360)] + [(500, k) for k in range(501, 560)] + [(5, 5)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    root = {n: n for e in edges for n in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert got == {n: find(n) for n in root if find(n) != n}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def toxic_rows(n=900):
    """Toxic are: an insult, or the pair of two words that are harmless alone."""
    rng = np.random.default_rng(9)
    plain, out = [f"plain{k}" for k in range(60)], []
    for k in range(n):
        words, kind = list(rng.choice(plain, 25)), int(rng.integers(0, 5))
        if kind == 1:
            words[3] = f"grobian{rng.integers(0, 30)}"
        elif kind in (2, 3):
            words[5] = "those" if kind == 2 else "vermin"
        elif kind == 4:
            words[5], words[9] = "those", "vermin"
        out.append((k, " ".join(words), int(kind in (1, 4))))
    return out


def test_toxicity_on_held_out_rows(spark):
    rows = toxic_rows()
    labels = spark.createDataFrame([(i, 0, y) for i, _, y in rows] + [(10_000, 1, 1), (None, 0, 1), (3, 0, None)], "doc_id long, quality int, toxic int")
    docs = documents(spark, [(i, t) for i, t, _ in rows] + [(None, None), (5, "")])
    model = toxicity.fit(docs, labels)
    got = toxicity.with_score(docs, model, score_col="score").select("doc_id", "text", "score", toxicity.held_out().alias("held"))
    truth = {i: y for i, _, y in rows}
    right = total = 0
    for r in got.collect():
        assert 0 <= r["score"] <= 1
        assert r["held"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 3 == 1)
        if r["held"] and r["text"]:
            total, right = total + 1, right + ((r["score"] >= toxicity.THRESHOLD) == bool(truth[r["doc_id"]]))
    assert total > 200 and right / total > 0.97
    assert toxicity.clean(docs, model).columns == docs.columns
    assert toxicity.clean(documents(spark, []), model).count() == 0


def crossed_rows(n, seed=3):
    """Toxic are: an insult; a slur with the one group, and a threat with the other. Slur, threat and groups mean nothing alone."""
    rng = np.random.default_rng(seed)
    plain, out = [f"plain{k}" for k in range(60)], []
    for k in range(n):
        words, first, second = list(rng.choice(plain, 25)), *map(int, rng.integers(0, 2, 2))
        if rng.random() < 0.7:
            words[3], words[9], y = ("slur", "threat")[first], ("zuluman", "yankee")[second], int(first == second)
        else:
            y = int(rng.random() < 0.2)
            words[5] = "grobian" if y else words[5]
        out.append((k, " ".join(words), y))
    return out


def area(scores, labels):
    """The share of pairs of a row of label 1 and one of label 0 that the scores order rightly."""
    scores, labels = np.asarray(scores), np.asarray(labels)
    a, b = scores[labels == 1][:, None], scores[labels == 0][None, :]
    return float((a > b).mean() + 0.5 * (a == b).mean())


@pytest.mark.parametrize("n", [300, 900, 12_000])
def test_factors_decide_about_pairs(n):
    """On rows that weren't fitted, a machine without its factors can't tell a pair from its words; so factors mustn't decay."""
    rows = [(np.array(sorted({h for w in t.split() for h in toxicity.term_hashes(w)})), y) for _, t, y in crossed_rows(n + 800)]
    terms = np.unique(np.concatenate([h for h, _ in rows[:n]]))
    at = [np.searchsorted(terms, h[np.isin(h, terms)]) for h, _ in rows]
    y = np.array([y for _, y in rows])
    model = toxicity.train(at[:n], y[:n].astype(float), terms)
    flat = toxicity.Model(model.terms, model.bias, model.weights, np.zeros_like(model.factors))
    held = [x.tolist() for x in at[n:]]
    assert area(model.margins(held), y[n:]) > 0.98 and area(flat.margins(held), y[n:]) < 0.9
    assert np.abs(model.factors).max() > 0.1
    changed = (model.margins(held) >= 0.847) != (flat.margins(held) >= 0.847)
    assert changed.mean() > 0.1


def test_training_equals_a_plain_loop():
    """The machine and its steps term by term, without vectors."""
    rng = np.random.default_rng(5)
    texts = [np.sort(rng.choice(12, int(rng.integers(0, 6)), replace=False)) for _ in range(40)]
    labels = np.array([float((1 in t and 2 in t) or 3 in t) for t in texts])
    for settings in toxicity.SETTINGS:
        b, w, v = toxicity.machine(texts, labels, 12, settings, factors=2, epochs=7)
        random = np.random.default_rng(7)
        w2, v2 = [0.0] * 12, random.normal(0, toxicity.FACTOR_START, (12, 2)).tolist()
        b2 = float(np.log(labels.sum() / (40 - labels.sum())))
        gw, gv, gb = [1e-8] * 12, [1e-8] * 12, 1e-8
        for epoch in range(7):
            order = random.permutation(40).tolist()
            for at in range(0, 40, toxicity.BATCH):
                batch = order[at : at + toxicity.BATCH]
                dw, dv, touched, total = {}, {}, set(), 0.0
                for k in batch:
                    t = texts[k].tolist()
                    pairs = sum(sum(v2[i][f] * v2[j][f] for f in range(2)) for n, i in enumerate(t) for j in t[:n])
                    error = (1 / (1 + np.exp(-(b2 + sum(w2[i] for i in t) + pairs))) - labels[k]) / len(batch)
                    total += error
                    for i in t:
                        touched.add(i)
                        dw[i] = dw.get(i, 0.0) + error
                        for f in range(2):
                            dv[i, f] = dv.get((i, f), 0.0) + error * sum(v2[j][f] for j in t if j != i)
                for i in touched:
                    gw[i] += dw[i] ** 2
                    step = toxicity.RATE / gw[i] ** 0.5
                    moved = w2[i] - step * dw[i]
                    w2[i] = np.sign(moved) * max(0.0, abs(moved) - step * settings.pull)
                    if epoch >= 7 // 6:
                        gv[i] += (dv[i, 0] ** 2 + dv[i, 1] ** 2) / 2
                        step = settings.rate_v / gv[i] ** 0.5
                        moved = [v2[i][f] - step * dv[i, f] for f in range(2)]
                        size = (moved[0] ** 2 + moved[1] ** 2) ** 0.5
                        v2[i] = [x * max(0.0, 1 - step * settings.pull_v / max(size, 1e-12)) for x in moved]
                gb += total**2
                b2 -= toxicity.RATE * total / gb**0.5
        assert b == pytest.approx(b2, rel=1e-6) and w == pytest.approx(np.array(w2), rel=1e-6, abs=1e-9) and v == pytest.approx(np.array(v2), rel=1e-6, abs=1e-9)
        some = [t.tolist() for t in texts]
        assert toxicity.Model(np.arange(12), b, w, v).margins(some) == pytest.approx([b2 + sum(w2[i] for i in t) + sum(np.dot(v2[i], v2[j]) for n, i in enumerate(t) for j in t[:n]) for t in some], rel=1e-6)


def test_common_terms_are_kept_whatever_they_mean_alone(spark):
    rows = crossed_rows(600)
    docs = documents(spark, [(i, t + " x" * 300_000 if i == 1 else t) for i, t, _ in rows]).withColumn("label", F.lit("clash"))
    model = toxicity.fit(docs, spark.createDataFrame([(i, 0, y) for i, _, y in rows], "doc_id long, quality int, toxic int"))
    known = set(model.terms.tolist())
    assert all(toxicity.term_hashes(w)[0] in known for w in ("slur", "threat", "zuluman", "yankee", "grobian", "plain"))
    got = {r["doc_id"]: r["score"] for r in toxicity.with_score(docs, model).collect()}
    held = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert area([got[i] for i, _ in held], [y for _, y in held]) > 0.95
    assert "score" in toxicity.with_score(docs, model).columns and toxicity.clean(docs, model).columns == docs.columns


def test_toxicity_without_labels_of_both_kinds(spark):
    docs = documents(spark, [(1, "a"), (2, "b")])
    none = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert {r["score"] < 1e-6 for r in toxicity.with_score(docs, none).collect()} == {True}
    one = toxicity.fit(docs, spark.createDataFrame([(k, 0, 1) for k in range(6)], "doc_id long, quality int, toxic int"))
    assert {r["score"] > 0.99 for r in toxicity.with_score(docs, one).collect()} == {True}


def test_labels_held_out_are_never_used(spark):
    rows = toxic_rows(300)
    docs = documents(spark, [(i, t) for i, t, _ in rows])
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    schema = "doc_id long, quality int, toxic int"
    one = toxicity.fit(docs, spark.createDataFrame([(i, 0, y) for i, _, y in rows], schema))
    two = toxicity.fit(docs, spark.createDataFrame([(i, 0, 1 - y if held(i) else y) for i, _, y in rows], schema))
    assert np.array_equal(one.terms, two.terms) and np.allclose(one.weights, two.weights)


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 2048, 2049, 70_000])
def test_media_round_trip(n):
    payload = matroska.payload_of(bytes(np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8)))
    data = matroska.mux(payload)
    media = matroska.demux(data)
    assert media.error is None and matroska.read_back(media, data) == payload
    assert len(payload) % 64 == 0 and len(payload) >= 64
    assert media.tracks[1]["codec"] == "A_PCM/INT/LIT" and media.tracks[1]["bits"] == 8 and media.tracks[1]["rate"] == 8000.0
    assert all(good for *_, good in media.cues) and len(media.cues) == len(media.clusters)
    times = [p[1] for p in media.packets]
    assert times == [k * 32_000_000 for k in range(len(times))] and media.duration == len(payload) / 8


def element(name, content):
    return matroska._element(name, content)


def block(frames, lacing, track=1, time=0, flags=0):
    return bytes([0x80 | track]) + time.to_bytes(2, "big", signed=True) + bytes([flags | lacing << 1]) + matroska.lace(frames, lacing)


@pytest.mark.parametrize("lacing", [matroska.NO_LACING, matroska.XIPH, matroska.FIXED, matroska.EBML_LACING])
def test_lacing_groups_and_unknown_sizes(lacing):
    frames = {matroska.NO_LACING: [b"abc"], matroska.FIXED: [b"aa", b"bb", b"cc"]}.get(lacing, [b"x" * 300, b"y" * 255, b"", b"z" * 9000, b"w" * 5])
    group = element(matroska.BLOCK_GROUP, element(matroska.BLOCK, block(frames, lacing, 2, -3)) + element(matroska.REFERENCE_BLOCK, b"\xff") + element(0xEC, b"void"))
    cluster = matroska.CLUSTER.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + matroska._number(matroska.CLUSTER_TIMESTAMP, 10) + group
    body = cluster + element(matroska.CLUSTER, matroska._number(matroska.CLUSTER_TIMESTAMP, 50) + element(matroska.SIMPLE_BLOCK, block(frames, lacing, 1, 4, 0x80)))
    data = matroska._HEADER + matroska.SEGMENT.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + body
    media = matroska.demux(data)
    assert media.error is None and len(media.clusters) == 2
    assert [data[p[2] : p[2] + p[3]] for p in media.packets] == frames * 2
    assert {p[:2] + (p[4],) for p in media.packets} == {(2, 7_000_000, False), (1, 54_000_000, True)}


def test_packet_table_and_faults(spark):
    good = matroska.mux(matroska.payload_of(b"hello" * 3000))
    files = [(1, good), (2, good[:-500]), (3, b"junk"), (4, b""), (5, None), (None, good)]
    got = matroska.packet_table(spark.createDataFrame(files, "id long, media binary"), "id", "media").collect()
    by = {}
    for r in got:
        by.setdefault(r["id"], []).append(r)
    assert [r["error"] for r in by["1"]] == [None] * len(by["1"]) and len(by["1"]) == len(by[None])
    assert by["2"][-1]["error"] and by["3"][-1]["error"] and by["4"][-1]["error"] == "no EBML header" and "5" not in by
    for cut in range(0, len(good), 97):
        matroska.demux(good[:cut])


UNKNOWN = b"\x01" + b"\xff" * 7


@pytest.mark.parametrize(
    "inner",
    [
        element(matroska.CLUSTER, element(matroska.BLOCK_GROUP, matroska.BLOCK.to_bytes(1, "big") + UNKNOWN + block([b"a"], 0))),
        element(matroska.TRACKS, element(matroska.TRACK_ENTRY, matroska.AUDIO.to_bytes(1, "big") + UNKNOWN)),
        element(matroska.TRACKS, matroska.TRACK_ENTRY.to_bytes(1, "big") + UNKNOWN + matroska._number(matroska.TRACK_NUMBER, 1)),
        element(matroska.INFO, matroska.TIMESTAMP_SCALE.to_bytes(3, "big") + UNKNOWN + b"\x01"),
        element(matroska.CUES, matroska.CUE_POINT.to_bytes(1, "big") + UNKNOWN),
        element(matroska.CUES, element(matroska.CUE_POINT, matroska.CUE_TRACK_POSITIONS.to_bytes(1, "big") + UNKNOWN)),
        element(matroska.INFO, matroska._number(matroska.TIMESTAMP_SCALE, (1 << 64) - 1)) + element(matroska.CLUSTER, matroska._number(matroska.CLUSTER_TIMESTAMP, 1 << 40) + element(matroska.SIMPLE_BLOCK, block([b"a"], 0))),
        element(matroska.CUES, element(matroska.CUE_POINT, matroska._number(matroska.CUE_TIME, (1 << 64) - 1))) + element(matroska.CLUSTER, b"\xe7\x89" + b"\x01" * 9),
        element(matroska.CLUSTER, element(matroska.SIMPLE_BLOCK, b"\x01" + b"\x7f" * 7 + b"\x00\x00\x00x")),
    ],
)
def test_malformed_parts_are_errors_not_crashes(spark, inner):
    data = matroska._HEADER + element(matroska.SEGMENT, element(matroska.CLUSTER, element(matroska.SIMPLE_BLOCK, block([b"fine"], 0))) + inner)
    rows = matroska.packet_table(spark.createDataFrame([(1, data)], "id long, media binary"), "id", "media").collect()
    assert rows[0]["error"] is None and rows[0]["size"] == 4
    assert rows[-1]["error"] or rows[-1]["track"] > 1 << 31


def test_feature_by_plain_counting():
    text = bytes(range(256)) * 20
    data = matroska.mux(matroska.payload_of(text))
    payload = matroska.payload_of(text)
    media = matroska.demux(data)
    wave = [x - 128 for x in payload]
    crossings = sum((a < 0) != (b < 0) for a, b in zip(wave, wave[1:]))
    frames = [payload[k : k + matroska.FRAME] for k in range(0, len(payload), matroska.FRAME)]
    assert matroska.feature(media, payload) == (
        f"tracks=1;clusters=1;packets={len(frames)};laced={len(frames)};cues=1;last_ms={(len(frames) - 1) * 32};level={sum(wave)};power={sum(x * x for x in wave)};crossings={crossings}"
    )
    # The stored bytes by a reader that knows nothing of the writer: frames are where the packets say, in order.
    assert [data[p[2] : p[2] + p[3]] for p in media.packets] == frames and data.startswith(b"\x1aE\xdf\xa3")


def test_stored_texts(spark):
    rows = [(1, "é" * 40), (2, ""), (3, None), (4, "a" * 64), (1, "é" * 40), (None, "x")]
    got = matroska.stored(documents(spark, rows).withColumn("feature", F.lit("clash"))).collect()
    assert len(got) == len(rows)
    for r in got:
        text = {1: "é" * 40, 4: "a" * 64, None: "x"}.get(r["doc_id"], "").encode()
        payload = text + b"\0" * (-len(text) % 64 or (0 if text else 64))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(text), len(payload), hashlib.sha256(payload).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(payload[-64:])
        assert (r["media_bytes"], r["media_sha256"]) == (len(matroska.mux(payload)), hashlib.sha256(matroska.mux(payload)).hexdigest())
    assert len({tuple(r[1:]) for r in got if r["doc_id"] == 1}) == 1
    assert matroska.stored(documents(spark, [])).count() == 0


def slow_search(rows, is_query, k):
    floor = lambda v: [int(np.floor(np.float64(x) * 256)) for x in v]
    usable = [(i, floor(v)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in usable if is_query(i)}):
        own = min(v for i, v in usable if i == q)
        best = {}
        for i, v in usable:
            if i != q and len(v) == len(own):
                s = sum(a * b for a, b in zip(own, v))
                best[i] = max(best.get(i, s), s)
        out += [(q, r, i, s) for r, (i, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k], 1)]
    return out


@pytest.mark.parametrize("per_round", [2, 1000])
def test_search(spark, per_round, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(k, [float(x) for x in rng.normal(size=4).round(1)]) for k in range(60)]
    rows += [(100 + k, [0.5, 0.5, 0.5, 0.5]) for k in range(40)] + [(7, rows[7][1]), (10, [9.0, 9.0, 9.0, 9.0]), (11, rows[10][1])]
    rows += [(200, None), (201, [1.0, None, 0.0, 0.0]), (202, [1.0, float("nan"), 0.0, 0.0]), (203, [float("inf"), 0.0, 0.0, 0.0]), (204, [1.0, 2.0]), (210, [3.0, 1.0]), (None, [1.0, 1.0, 1.0, 1.0])]
    rows += [(220, []), (230, []), (240, [1e30, 1e30, 1e30])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, label int").withColumn("score", F.lit("x")).repartition(4)
    got = topk.search(df, F.col("vec_id") % 10 == 0, k=3, queries_per_round=per_round)
    expected = slow_search(rows, lambda i: i % 10 == 0, 3)
    assert sorted(map(tuple, got.collect())) == sorted(expected)


def test_search_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert topk.search(empty, F.col("vec_id") % 50 == 0).count() == 0


def test_exact_beyond_floats():
    a = np.array([[2.0**40, 3.0], [2.0**62, 2.0**62]])
    assert topk.scores(a[:1], a[:1]).tolist() == [[min((2**80) + 9, 2**63 - 1)]]
    assert topk.scores(a[:1], np.array([[2.0**14, -5.0]])).tolist() == [[2**54 - 15]]


PAGE = """<!DOCTYPE html><html><head><title>T{k}</title><style>p{{}}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<nav><ul><li><a href="/">Home</a></li><li>Menu</li></ul></nav><!-- x --><div class="ad">Buy {k}</div><div class="cookie-notice">We use cookies</div>
<article><h1>Title &amp; {k}</h1><p>First <b>bold</b>{k}<br>line&nbsp;two.<p>Second   {k}
</p><ul><li>one<li>two</ul><form><input value="q">Search</form><aside>Side</aside><div id="comments"><p>Nice!</p></div></article>
<div class="sidebar">Links</div><footer>&copy; Foo</footer></body></html>"""


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def expected_text(k):
    return f"Title & {k}\nFirst bold{k} line two.\nSecond {k}\none\ntwo"


def test_html(spark):
    rows = [(k, f"https://a.example.com/{k}", PAGE.format(k=k)) for k in range(8)]
    rows += [(50, "https://few.example.com/", PAGE.format(k=50)), (51, None, None), (52, "x", ""), (53, "https://a.example.com/x", "<p>broken <b>off &am"), (0, rows[0][1], rows[0][2])]
    df = pages(spark, rows).withColumn("host", F.lit("clash")).withColumn("text", F.lit("clash"))
    got = html_template.extract(df).collect()
    assert len(got) == len(rows)
    for r in got:
        text = {51: "", 52: "", 53: "broken off &am"}.get(r["page_id"], expected_text(r["page_id"]))
        assert (r["text"], r["n_chars"]) == (text, len(text)), r["page_id"]
        assert (r["template_tokens"] > 0) == (r["url"] or "").startswith("https://a.")
    shuffled = html_template.extract(df, broadcast_bytes=0)
    assert sorted(map(str, shuffled.collect())) == sorted(map(str, got))
    assert html_template.extract(pages(spark, [])).count() == 0


def test_constant_text_is_template_where_no_article_is_marked(spark):
    page = "<html><body><div><p>Welcome to Foo</p><p>Story number {k} goes like this.</p><p>All rights reserved</p></div></body></html>"
    rows = [(k, "http://foo.example.org/a", page.format(k=k)) for k in range(6)] + [(9, "http://bar.example.org/a", page.format(k=9))]
    got = {r["page_id"]: r["text"] for r in html_template.extract(pages(spark, rows)).collect()}
    assert [got[k] for k in range(6)] == [f"Story number {k} goes like this." for k in range(6)]
    assert got[9] == "Welcome to Foo\nStory number 9 goes like this.\nAll rights reserved"


def test_copies_of_an_article_stay(spark):
    rows = [(k, "http://foo.example.org/a", PAGE.format(k=1)) for k in range(5)]
    assert {r["text"] for r in html_template.extract(pages(spark, rows)).collect()} == {expected_text(1)}


def test_copies_of_an_unmarked_page_stay(spark):
    page = "<html><body><nav>{n}</nav><div><p>Story {k}</p><p>goes like {k}.</p></div></body></html>"
    rows = [(n, "http://one.example.org/a", page.format(k=1, n=n)) for n in range(3)]
    rows += [(10 + n, "http://half.example.org/a", page.format(k=max(n, 4), n=0)) for n in range(9)]
    got = {r["page_id"]: r["text"] for r in html_template.extract(pages(spark, rows)).collect()}
    assert {got[n] for n in range(3)} == {"Story 1\ngoes like 1."}
    assert [got[10 + n] for n in range(9)] == [f"Story {max(n, 4)}\ngoes like {max(n, 4)}." for n in range(9)]


def test_each_layout_has_a_template(spark):
    page = "<html><body><div class='{c}'><p>Welcome to {c}</p><div>Story {k}</div><p>All rights of {c}</p></div></body></html>"
    rows = [(k, "http://foo.example.org/a", page.format(c="xyz"[k % 3], k=k)) for k in range(12)]
    got = {r["page_id"]: r["text"] for r in html_template.extract(pages(spark, rows)).collect()}
    assert got == {k: f"Story {k}" for k in range(12)}


def test_furniture_in_a_line_is_no_slot_of_others(spark):
    page = "<html><body><article><div>Story {k}</div><a class=share><div>Share</div></a></article></body></html>"
    rows = [(k, "http://foo.example.org/a", page.format(k=k)) for k in range(6)]
    assert {r["page_id"]: r["text"] for r in html_template.extract(pages(spark, rows)).collect()} == {k: f"Story {k}" for k in range(6)}


def test_main_text_beside_an_article_stays(spark):
    page = "<html><body><div class='story'><p>Story {k}</p><p>Read all of it</p></div><article class='teaser'><p>Teaser {k}</p></article></body></html>"
    rows = [(k, "http://foo.example.org/a", page.format(k=k)) for k in range(6)]
    assert {r["page_id"]: r["text"] for r in html_template.extract(pages(spark, rows)).collect()} == {k: f"Story {k}\nTeaser {k}" for k in range(6)}


def test_classes_nest(spark):
    rows = [(k, "http://foo.example.org/a", f"<html><body><div class='box'><p>{'x</p><p>' * (k % 3)}{k}</p></div>" + "<ul><li>a</ul>" * (k % 2) + "</body></html>") for k in range(12)]
    df = pages(spark, rows).withColumn("host", html_template.host_of(F.col("url")))
    found = {tuple(r["paths"]): r for r in html_template.nested(html_template.classes(html_template.counted(df, 3), 3, 0.4)).collect()}
    inner = next(r for p, r in found.items() if ">html>body>ul" in p)
    outer = next(r for p, r in found.items() if ">html>body" in p)
    assert inner["parent"] == outer["class"] and outer["pages"] == 12 and inner["pages"] == 6


UNNAMED = """<html><body><div class="q1"><ul><li><a href="/a">Home {k}</a></li><li><a href="/b">More {k}</a></li></ul></div>
<div class="z9">Buy this thing number {k} now</div><h1>Headline {k}</h1><div class="k3"><div class="k4"><p>Story {k} goes on like this for a while, as stories do.</p>
<p>It has a second paragraph, number {k}, and that one is longer than what stands around it, which is how a main text is known from what goes with it on a page that names none of its parts {k}.</p><p>Read also what we wrote</p></div></div><div class="z8">Host text for page {k}</div></body></html>"""


def unnamed_text(k):
    return f"Headline {k}\nStory {k} goes on like this for a while, as stories do.\nIt has a second paragraph, number {k}, and that one is longer than what stands around it, which is how a main text is known from what goes with it on a page that names none of its parts {k}."


def test_the_template_decides_where_nothing_is_named(spark):
    """Without deduction the menu, the advert, the host's line and the line on all pages stay."""
    df = pages(spark, [(k, "http://foo.example.org/a", UNNAMED.format(k=k * k)) for k in range(8)])
    got = {r["page_id"]: r["text"] for r in html_template.extract(df).collect()}
    assert got == {k: unnamed_text(k * k) for k in range(8)}
    off = {r["page_id"]: r["text"] for r in html_template.extract(df, least_pages=10**9).collect()}
    assert all(off[k].count("\n") == 7 and "Buy this" in off[k] and "Home" in off[k] for k in range(8))
    assert {r["content"] for r in html_template.templates(df.withColumn("host", html_template.host_of(F.col("url")))).collect()} == {">html>body>div.k#>div.k#"}


def test_a_line_on_all_pages_goes_from_a_marked_article_but_copies_stay(spark):
    page = "<html><body><nav>N</nav><article><p>{a}</p><p>{b}</p><p>Read also what we wrote</p></article></body></html>"
    long = "This sentence is as long as a sentence in an article may well be"
    rows = [(k, "http://foo.example.org/a", page.format(a=f"{long} {k}", b=f"{k} {long}")) for k in range(6)]
    rows += [(10 + k, "http://copies.example.org/a", page.format(a=long, b=f"edit {k}")) for k in range(6)]
    got = {r["page_id"]: r["text"] for r in html_template.extract(pages(spark, rows)).collect()}
    assert got == {k: f"{long} {k}\n{k} {long}" for k in range(6)} | {10 + k: f"{long}\nedit {k}\nRead also what we wrote" for k in range(6)}


@pytest.mark.parametrize("n", [1, 6])
@pytest.mark.parametrize("name", ["class='related-work'", "class='ad-hoc'", "class='menu-prices'", "id='social-history'", "class='x'"])
def test_names_that_hold_a_word_of_furniture_stay_in_the_article(spark, name, n):
    page = "<html><body><div class='ad'>Buy</div><article><p>Story {k}</p><section {name}><p>Section {k}</p></section><div class='post-comments'><p>Nice {k}</p></div></article></body></html>"
    got = {r["page_id"]: r["text"] for r in html_template.extract(pages(spark, [(k, "http://foo.example.org/a", page.format(k=k, name=name)) for k in range(n)])).collect()}
    assert got == {k: f"Story {k}\nSection {k}" for k in range(n)}


@pytest.mark.parametrize("n", [1, 6])
def test_main_with_a_teaser(spark, n):
    page = "<html><body><main><article class='teaser'><p>Teaser {k}</p></article><p>A long paragraph that says {k} what the page is about.</p></main></body></html>"
    got = {r["page_id"]: r["text"] for r in html_template.extract(pages(spark, [(k, "http://foo.example.org/a", page.format(k=k)) for k in range(n)])).collect()}
    assert got == {k: f"Teaser {k}\nA long paragraph that says {k} what the page is about." for k in range(n)}


def test_classes_are_those_of_counted_occurrence_vectors(spark):
    """Classes and their shares by plain counting: a vector for each token of a host over its distinct pages."""
    rng = np.random.default_rng(3)
    parts = ["<nav><p>menu</p></nav>", "<div class='a'><p>hello</p></div>", "<ul><li>x<li>y</ul>", "<div class='b'><h2>t</h2><p>same</p></div>", "<footer>f</footer>"]
    rows = []
    for k in range(40):
        body = "".join(x * int(rng.integers(0, 3)) for x in parts)
        rows.append((k, f"http://h{k % 2}.example.org/", f"<html><body>{body}<p>{k // 3}</p></body></html>"))
    df = pages(spark, rows).withColumn("host", html_template.host_of(F.col("url")))
    got = {}
    for r in html_template.classes(html_template.counted(df, 3), 3, 0.3).collect():
        got.setdefault((r["host"], r["class"]), set()).add((r["path"], r["token"], r["furniture"]))
    expected = set()
    for h in (0, 1):
        distinct = {}
        for k, _, page in rows:
            if k % 2 == h:
                said, tokens = html_template.page_tokens(page)
                distinct[said] = min(distinct.get(said, (1 << 64, None)), (xxhash.xxh64_intdigest(page.encode()) >> 1, {t: x[0] for t, x in tokens.items()}), key=lambda x: x[0])
        seen = [t for _, t in distinct.values()]
        vectors = {t: tuple(p.get(t, 0) if t in p else -1 for p in seen) for t in {t for p in seen for t in p}}
        n_pages = {t: sum(t in p for p in seen) for t in vectors}
        alike = {}
        for t, v in vectors.items():
            if n_pages[t] >= 3:
                alike.setdefault(v, set()).add(t)
        for group in alike.values():
            if len(group) >= 2:
                around = {t: max((n_pages[u] for u in n_pages if u[1] == 0 and n_pages[u] >= 3 and u[0] == (t[0] if t[1] else t[0].rpartition(">")[0])), default=None) for t in group}
                valid = {t for t in group if around[t] is not None and n_pages[t] >= 0.3 * around[t]}
                if valid:
                    expected.add((f"h{h}.example.org", frozenset(valid)))
    assert {(h, frozenset(x)) for (h, _), x in got.items()} == expected and len(expected) > 4


@pytest.mark.parametrize(
    ("page", "texts"),
    [
        ("a<p>b<p>c</div>d", ["a", "b", "c", "d"]),
        ("<p title='x>y' class=\"k\">t</p>", ["t"]),
        ("<script>if (a<b) {}</script>z", ["z"]),
        ("<script>never closed", []),
        ("1 < 2 &lt;b&gt; &#x41;&#66; &nbsp; &unknown;", ["1 < 2 <b> AB &unknown;"]),
        ("x<!-- never closed <p>y", ["x"]),
        ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]),
        ("<b>in<i>line</b> text</i>", ["inline text"]),
        ("<p>a<span class='ad'>buy</span> b</p>", ["a b"]),
        ("<a href='x", []),
        ("<p hidden>no</p><p>yes</p>", ["yes"]),
        ("<div class='post-comments'>no</div><article class='comment-body'>no</article><article class='notice'>yes</article>", ["yes"]),
        ("<div class='sidebar-right'><main>in<nav>no</nav></main>out</div>", ["in"]),
        ("<div class='content-with-sidebar'>in</div><div class='left sidebar'>out</div>", ["in"]),
    ],
)
def test_blocks(page, texts):
    assert [b.text for b in html_template.blocks(page) if not b.furniture] == texts


def test_media_column_types():
    assert pa.types.is_binary(pa.array([matroska.mux(b"\0" * 64)]).type)
