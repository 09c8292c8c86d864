"""Each operator on small tables: brute force, round trips, and the cases nulls, empty, long, ties, extra columns."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtrace.llm import bpe, exact_dedup, license_scan, mixing, near_dedup, quality, secret_scan, sharding, suffix_dedup, toxicity

R = random.Random(5)
VOCABULARY = ["".join(R.choice("abcdefghij") for _ in range(R.randint(2, 7))) for _ in range(300)]


def prose(n):
    return " ".join(R.choice(VOCABULARY) for _ in range(n))


BASE = [prose(120) for _ in range(12)]
TEXTS = [
    None, "", "   \n\t", "word", *BASE, BASE[0], BASE[0].upper(), BASE[1] + " tail of a near copy", BASE[2][:300] + " cut " + BASE[2][300:], "the same words again " * 40, BASE[3][50:400] + prose(60), prose(4000), "Ünïcödé \x00 zero ñ " * 20, "Ünïcödé \x00 zero ñ " * 20,
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i % 5 == 0 else f"src{i % 3}", f"extra{i}", i) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, _id string, n long").repartition(3)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


ALL = {
    "quality": quality.judge, "mixing": mixing.mix, "near": near_dedup.link, "exact": exact_dedup.exact_groups, "bpe": bpe.digests, "suffix": suffix_dedup.remove_repeats, "sharding": sharding.shard, "license": license_scan.scan_licenses, "secret": secret_scan.scan_secrets,
}


@pytest.mark.parametrize("name", ALL)
def test_empty_table(docs, name):
    assert ALL[name](docs.limit(0)).count() == 0


def test_quality(docs):
    got = by_id(quality.judge(docs.select("doc_id", "text", "n")))
    for i, t in enumerate(TEXTS):
        ws = [w for w in "".join(c if c not in " \t\n\x0b\x0c\r" else " " for c in t or "").split(" ") if w]
        windows = Counter(tuple(ws[k : k + 3]) for k in range(len(ws) - 2))
        covered = {k + j for k in range(len(ws) - 2) if windows[tuple(ws[k : k + 3])] > 1 for j in range(3)}
        assert (got[i]["n_words"], got[i]["n_repeat_words"], got[i]["word_chars"]) == (len(ws), len(covered), sum(map(len, ws))), i
        assert got[i]["base_failed"] == (len(ws) < 50 or 100 * len(covered) > 50 * len(ws))
    assert got[4]["kept"] and not got[0]["kept"]


def test_mixing(docs):
    rows = [r.asDict() for r in mixing.mix(docs).collect()]
    assert len(rows) == len(TEXTS)
    size, taken, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    assert sum(target.values()) == pytest.approx(sum(size.values()))
    for s in size:
        assert target[s] <= 3 * size[s] + 1e-6
        assert abs(taken[s] - target[s]) <= max(r["size"] for r in rows if r["source"] == s)
    assert sorted(map(str, rows)) == sorted(str(r.asDict()) for r in mixing.mix(docs).collect())


def test_exact(docs):
    got, groups = by_id(exact_dedup.exact_groups(docs)), defaultdict(list)
    for i, t in enumerate(TEXTS):
        groups[(t or "").encode().lower()].append(i)
    for text, ids in groups.items():
        for i in ids:
            assert tuple(got[i])[1:] == (max(ids), len(ids), i == max(ids), hashlib.sha256(text).hexdigest())


def test_quotient_filters_merge_losslessly():
    r = np.random.default_rng(1)
    parts = [np.unique(r.integers(0, 1 << 40, 500, dtype=np.uint64) >> np.uint64(28), return_counts=True) for _ in range(4)]
    total = Counter()
    for k, c in parts:
        total.update(dict(zip(k.tolist(), c.tolist())))
        a, b = exact_dedup.decode_filter(exact_dedup.encode_filter(k, c, 40), 40)
        assert (a == k).all() and (b == c).all()
    keys, counts = exact_dedup.merge_filters([exact_dedup.encode_filter(k, c, 40) for k, c in parts], 40)
    assert dict(zip(keys.tolist(), counts.tolist())) == total and (np.diff(keys.astype(np.int64)) > 0).all()


def shingle_set(t):
    ws = (t or "").encode().lower().split()
    return {tuple(ws)} if 0 < len(ws) < 5 else {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)}


def brute_components(texts):
    sets, root = [shingle_set(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                lo, hi = sorted((root[i], root[j]))
                root = [lo if x == hi else x for x in root]
    return sets, root


def test_near(docs, spark):
    got = by_id(near_dedup.link(docs))
    sets, root = brute_components(TEXTS)
    assert {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in got.items()} == {
        i: (len(sets[i]), root[i], root[i] == i) for i in range(len(TEXTS))
    }


def test_near_large_family(spark):
    base, texts = [str(x) for x in range(150)], []
    for _ in range(120):  # copies so far from each other that many aren't linked directly
        own = list(base)
        for k in R.sample(range(150), R.randint(0, 9)):
            own[k] = f"x{R.randint(0, 10**6)}"
        texts.append(" ".join(own))
    got = by_id(near_dedup.link(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    _, root = brute_components(texts)
    assert [got[i]["component_id"] for i in range(len(texts))] == root


def test_bpe_round_trip(docs):
    import tiktoken

    path, pattern = bpe.default_path(), bpe.default_pattern()
    ref = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.ranks(path), special_tokens={})
    got = by_id(bpe.encode(docs))
    for i, t in enumerate(TEXTS):
        ids = ref.encode_ordinary(t or "")
        assert got[i]["ids"] == ids and got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
        assert len(got[i]["starts"]) == len(ids) and (not ids or got[i]["ends"][-1] == len(t))
    assert by_id(bpe.digests(docs))[4]["ids_sha256"] == got[4]["ids_sha256"]


def brute_repeats(texts):
    datas = [(t or "").encode() for t in texts]
    least, out = {}, []
    for i, d in enumerate(datas):
        for p in range(len(d) - 49):
            least.setdefault(d[p : p + 50], i)
    for i, d in enumerate(datas):
        gone = np.zeros(len(d), bool)
        for p in range(len(d) - 49):
            if least[d[p : p + 50]] < i:
                gone[p : p + 50] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((len(d), int(gone.sum()), spans, hashlib.sha256(bytes(x for x, g in zip(d, gone) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [20_000, 1])
def test_suffix(docs, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    got = by_id(suffix_dedup.remove_repeats(docs))
    assert [tuple(got[i])[1:] for i in range(len(TEXTS))] == brute_repeats(TEXTS)


def test_interleave_equals_sorting():
    pieces = [sorted({bytes(R.choice(b"ab") for _ in range(R.randint(3, 60))) for _ in range(8)}) for _ in range(4)]
    bwts = [np.frombuffer(suffix_dedup.transform(p), np.uint8) for p in pieces]
    suffixes = []
    for p, b in zip(pieces, bwts):
        own, at = suffix_dedup.rows_of_pieces(b, np.array([len(x) for x in p]))
        found = [p[i][k:] for i, k in zip(own, at)]
        assert found == sorted(found)
        suffixes += found
    for depth in (1, 3, 20):
        rows, begins = suffix_dedup.interleave(bwts, depth)
        whole = [(suffixes[r][:depth], b) for r, b in zip(rows, begins) if len(suffixes[r]) >= depth]
        assert [s for s, _ in whole] == sorted(s for s, _ in whole)
        assert all(b == (s != t) for (t, _), (s, b) in zip(whole, whole[1:]) if b or s == t)


def test_toxicity(spark):
    rows, labels = [], []
    for i in range(600):
        toxic = i % 6 == 0
        rows.append((i, prose(30) + (f" you {R.choice(['grobnar', 'grobnarish', 'vilk'])} . " if toxic else " . ") + prose(20)))
        labels.append((i, int(toxic), "x"))
    rows += [(600, None), (601, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int, text string"))
    got = by_id(toxicity.score(docs, model))
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([got[i]["predicted"] == int(i % 6 == 0) for i in held]) > 0.98
    assert got[600]["predicted"] == got[601]["predicted"] == 0
    kept = toxicity.keep_clean(docs.withColumn("source", F.lit("s")), model)
    assert kept.columns == ["doc_id", "text", "source"] and kept.filter("doc_id = 1").count() == 1


def least_capacity(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        mid, used, room = (low + high) // 2, 1, None
        room = mid
        for s in sizes:
            if s > room:
                used, room = used + 1, mid
            room -= s
        low, high = (low, mid) if used <= shards else (mid + 1, high)
    return low


@pytest.mark.parametrize("local", [50_000, 0])
def test_sharding(docs, monkeypatch, local):
    if local == 0:
        monkeypatch.setattr(sharding, "MOST_LOCAL", 30)
    got = by_id(sharding.shard(docs))
    groups = defaultdict(int)
    for i, t in enumerate(TEXTS):
        data = (t or "").encode()
        assert (got[i]["size"], got[i]["text_crc32"], got[i]["law"]) == (len(data) + 1, zlib.crc32(data), "bytes")
        groups[hashlib.sha256(data).hexdigest()] += len(data) + 1
    loads, slots, placed = Counter(), defaultdict(list), defaultdict(set)
    for i, r in got.items():
        loads[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        placed[TEXTS[i] or ""].add(r["shard"])
    assert max(loads.values()) == least_capacity([groups[k] for k in sorted(groups)], 8)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(s) == 1 for s in placed.values())


def test_licenses(spark):
    texts = [
        "Released under the MIT-License!",
        "Licensed undr the Apache Licence, Version 2.0",
        "no notice",
        None,
        "MIT license, mit license and General  Public\nLicense",
        "x " * 5000 + "Licensed under CC BY-NC 4.0.",
    ]
    got = by_id(license_scan.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert (got[0]["n_base"], got[0]["first_word"], got[0]["labels"]) == (1, 3, "mit")
    assert (got[1]["n_base"], got[1]["base_labels"], got[1]["labels"]) == (0, "", "apache") and 0 < got[1]["score"] < 1
    assert (got[2]["labels"], got[2]["first_word"], got[3]["n_words"]) == ("", None, 0)
    assert (got[4]["n_base"], got[4]["base_labels"], got[4]["last_word"]) == (3, "gpl,mit", 5)
    assert got[5]["labels"] == "cc-by-nc" and got[5]["n_words"] == 5007


def test_fuzzy_search_equals_matching_everywhere():
    import regex

    scanner, notice = license_scan.Scanner(), "licensed under the apache license version 2 0"
    for _ in range(60):
        own = list(notice)
        for _ in range(R.randint(0, 5)):
            k = R.randrange(len(own))
            own[k : k + 1] = R.choice([[], [own[k], "q"], ["z"]])
        text = prose(10) + " " + "".join(own) + " " + prose(10)
        everywhere = regex.search(f"(?b)(?:{regex.escape(notice)}){{e<={len(notice) // license_scan.CHARS_PER_ERROR}}}", text)
        assert bool(everywhere) == any(x[0] == "apache" for x in scanner.notices(text))


def test_secrets(spark):
    hexes = "0123456789abcdef" * 2
    texts = [
        f'token = "{hexes}"',
        "AKIA" + "A1" * 8,
        "password: short",
        None,
        f"call sk_live_{'aB3' * 8}7 now",
        "see https://example.com/a/b/12.html",
        "secret=" + "x" * 12 + " plain",
    ]
    got = by_id(secret_scan.scan_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert got[0]["spans"] == f"assign:0:{len(texts[0]) - 1},hex:9:41" and (got[0]["n_assign"], got[0]["n_hex"]) == (1, 1)
    assert got[1]["spans"] == "access:0:20" and got[2]["spans"] == "" and got[3]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert got[4]["n_crf"] == 1 and got[5]["n_crf"] == 0 and got[6]["spans"] == "assign:0:19"


def test_viterbi_equals_all_taggings():
    from itertools import product

    moves = secret_scan.trained().moves
    r = np.random.default_rng(3)
    for n in (1, 2, 4):
        emit = r.normal(size=(n, 3))
        value = lambda tags: (
            emit[range(n), tags].sum() + secret_scan._FIRST[tags[0]] + sum(moves[a, b] for a, b in zip(tags, tags[1:]))  # noqa: B023, E731
        )
        assert secret_scan.viterbi(emit, moves) == list(max(product(range(3), repeat=n), key=value))


def test_pipeline_stages(docs, spark, tmp_path):
    import corpus_pipeline

    (
        spark.createDataFrame([(i, 0, int(i == 3)) for i in range(len(TEXTS))], "doc_id long, quality int, toxic int").write
        .parquet(f"{tmp_path}/labels.parquet")
    )
    table = docs.select("doc_id", "text", F.lit("en").alias("lang"), "source", F.col("n").alias("n_chars"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, table, str(tmp_path))
        if name != "bpe":
            assert out.columns == table.columns, name
        out.write.parquet(f"{tmp_path}/{name}")
        table = spark.read.parquet(f"{tmp_path}/{name}")
    near = spark.read.parquet(f"{tmp_path}/near_dedup")
    kept = [TEXTS[r["doc_id"]] for r in near.collect()]
    assert len(brute_components(kept)[1]) == len(set(brute_components(kept)[1]))
    assert table.count() == spark.read.parquet(f"{tmp_path}/mixing").count()
