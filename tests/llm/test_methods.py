"""The methods against brute force, and the cases that every operator and stage handles: repeated rows, very long texts, clashing names, empty tables."""

import hashlib
import math
import random
from collections import Counter
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtrace.llm import bpe, exact_dedup, license_scan, mixing, near_dedup, quality, secret_scan, sharding, suffix_dedup, toxicity
from loomtrace.llm import common
from loomtrace.llm.common import join_heavy, numbered, semi_heavy, slices

R = random.Random(11)
LETTERS = "abcdefghilmnoprstuvz"


def word(lo=2, hi=9):
    return "".join(R.choice(LETTERS) for _ in range(R.randint(lo, hi)))


def prose(n):
    return " ".join(word() + ("." if R.random() < 0.08 else "") for _ in range(n))


SMALL = [prose(60), prose(70), None, "", "one two", prose(55)]
LONG = prose(200_000)
ROWS = [*enumerate(SMALL), (0, SMALL[0]), (0, SMALL[0]), (2, None), (9, SMALL[1].upper()), (10, LONG), (10, LONG)]


@pytest.fixture(scope="module")
def awkward(spark):
    """Repeated rows, a text of over a million characters, and columns whose names the operators use themselves."""
    rows = [(i, t, f"s{i % 2}" if i else None, i, i, i, "x", "x", "x", i) for i, t in ROWS]
    return (
        spark.createDataFrame(
            rows,
            "doc_id long, text string, source string, _id long, copies long, _n long, row string, place string, rank string, size long",
        )
        .repartition(3)
    )


OPERATORS = {
    "quality": quality.judge, "mixing": mixing.mix, "near": near_dedup.link, "exact": exact_dedup.exact_groups, "bpe": bpe.digests, "suffix": suffix_dedup.remove_repeats, "sharding": sharding.shard, "license": license_scan.scan_licenses, "secret": secret_scan.scan_secrets,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_rows(awkward, name):
    """A row for every row; rows that repeat each other get the same values but for their places."""
    got = [r.asDict() for r in OPERATORS[name](awkward).collect()]
    assert len(got) == len(ROWS)
    for i in {i for i, _ in ROWS}:
        same = [{k: v for k, v in r.items() if k != "slot"} for r in got if r["doc_id"] == i]
        assert len(same) == sum(x == i for x, _ in ROWS) and all(x == same[0] for x in same), i


def test_slices_bound_texts():
    import pyarrow as pa

    batch = pa.record_batch({"id": list(range(6)), "text": ["a" * 5, None, "b" * 30, "", "c" * 4, "d" * 4]})
    parts = list(slices(batch, 1, 10))
    assert [p.column(0).to_pylist() for p in parts] == [[0, 1], [2], [3, 4, 5]]
    assert list(slices(batch.slice(0, 0))) == []


def test_numbered(spark):
    values = [R.randint(0, 50) for _ in range(500)]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v int, i int").repartition(7)
    got = sorted((r["place"], r["v"], r["i"]) for r in numbered(df, F.desc("v"), F.col("i")).collect())
    assert [(v, i) for _, v, i in got] == sorted(((v, i) for i, v in enumerate(values)), key=lambda x: (-x[0], x[1])) and [p for p, *_ in got] == list(range(500))
    assert numbered(df.limit(0), F.col("v")).count() == 0


@pytest.mark.parametrize("heavy", [1, 3, 2_000])
def test_hot_keys_join_as_others(spark, monkeypatch, heavy):
    monkeypatch.setattr(common, "HEAVY", heavy)
    keys = [R.choice([None, "hot", "hot", "hot", *"abcdef"]) for _ in range(300)]
    left = spark.createDataFrame(list(enumerate(keys)), "i int, k string")
    counts = Counter(k for k in keys if k and k != "f")
    right = spark.createDataFrame([(k, n, k.upper()) for k, n in counts.items()], "k string, n long, v string")
    got = {r["i"]: r["v"] for r in join_heavy(left, right, ["k"], "n").collect()}
    assert got == {i: k.upper() if k in counts else None for i, k in enumerate(keys)}
    assert join_heavy(left, right, ["k"], "n", "inner").count() == sum(counts.values())
    assert join_heavy(left.limit(0), right.limit(0), ["k"], "n").count() == 0
    assert {r["i"] for r in semi_heavy(left, right, "k", "n", "i").collect()} == {i for i, k in enumerate(keys) if k in counts}
    assert semi_heavy(left, right, "k", "n", "i").columns == ["k", "i"] and semi_heavy(left, right.limit(0), "k", "n", "i").count() == 0


def fitted_posteriors(patterns):
    """Expectation maximisation over rows, one by one."""
    votes = [[p // 3**j % 3 - 1 for j in range(len(quality.RULES))] for p in patterns]
    prior, rates = quality.START_PRIOR, [dict(quality.START) for _ in quality.RULES]

    def good(v):
        odds = math.log(prior / (1 - prior))
        for x, r in zip(v, rates):
            odds += math.log(r["bad_of_good"] / r["bad_of_bad"]) if x < 0 else math.log(r["good_of_good"] / r["good_of_bad"]) if x > 0 else 0
        return 1 / (1 + math.exp(-odds))

    for _ in range(quality.ITERATIONS):
        q = [good(v) for v in votes]
        fresh = []
        for j in range(len(quality.RULES)):
            own = {}
            for kind, start in quality.START.items():
                weight = [x if kind.endswith("good") else 1 - x for x in q]
                cast = sum(w for w, v in zip(weight, votes) if v[j] == (-1 if kind.startswith("bad") else 1))
                own[kind] = min(quality.RATE[1], max(quality.RATE[0], (cast + quality.SMOOTHING * start) / (sum(weight) + quality.SMOOTHING)))
            fresh.append(own)
        prior, rates = min(quality.PRIOR[1], max(quality.PRIOR[0], sum(q) / len(q))), fresh
    return [good(v) for v in votes]


def test_posteriors_equal_expectation_maximisation(spark):
    patterns = [sum(R.choice((0, 0, 1) if i % 4 == 0 else (1, 2, 2)) * 3**j for j in range(len(quality.RULES))) for i in range(300)]
    got = {r["pattern"]: r["posterior"] for r in quality.posteriors(spark.createDataFrame([(p,) for p in patterns], "pattern long")).collect()}
    for p, q in zip(patterns, fitted_posteriors(patterns)):
        assert got[p] == pytest.approx(q, abs=1e-9)


def test_quality_verdict_rejects_what_the_base_lets_pass(spark):
    good = [prose(120) + " a la el de en un. " + " ".join(f"{word()} de la {word()}." for _ in range(30)) for _ in range(80)]
    junk = [" ".join(f"{word(7, 9)}###" for _ in range(150)) for _ in range(20)]
    got = quality.judge(spark.createDataFrame(list(enumerate(good + junk)), "doc_id long, text string")).collect()
    assert not any(r["base_failed"] for r in got)
    assert all(r["kept"] == (r["doc_id"] < 80) for r in got)


def test_grammar_equals_enumeration():
    def best(clause):
        values = []

        def walk(machines, symbols, gains):
            if not machines:
                values.append(sum(g * w for g, (_, w) in zip(gains, clause)))
                return
            for out, own in machines[0].paths(symbols):
                walk(machines[1:], out, [a * b for a, b in zip(gains, own)])

        walk(toxicity.cascade(), [k for k, _ in clause], [1.0] * len(clause))
        return max(values, default=0.0)

    for _ in range(200):
        kinds = [R.choice(toxicity.SYMBOLS) for _ in range(R.randint(1, 8))]
        clause = [(k, R.random() * 5 if k == "insult" else toxicity.THREAT_WEIGHT if k == "threat" else 0.0) for k in kinds]
        assert toxicity.clause_score(clause, toxicity.grammar()) == pytest.approx(best(clause))


def test_grammar_clauses():
    score = lambda *symbols: toxicity.clause_score(
        [(s, 4.0 if s == "insult" else 3.0 if s == "threat" else 0.0) for s in symbols],
        toxicity.grammar(),
    )
    assert score("insult") == 4.0
    assert score("target", "word", "insult") == score("insult", "word", "target") == 6.0
    assert score("negation", "insult") == 1.0 and score("report", "word", "insult") == 2.0
    assert score("threat") == 0.0 and score("threat", "target") == 3.0
    assert score("insult", *["word"] * 6, "target") == 4.0  # too far
    assert score() == 0.0


def test_toxicity_model_does_not_depend_on_the_layout(spark):
    rows = [(i, prose(25) + (f" {R.choice(['gromnar', 'gromnarish', 'vilkor'])} you." if i % 5 == 0 else ".") + prose(10), int(i % 5 == 0)) for i in range(400)]
    rows += [(1000 + i, *rows[5 * i][1:]) for i in range(30)]  # copies
    docs, labels = (
        spark.createDataFrame(rows, "doc_id long, text string, toxic int")
        .drop("toxic"), spark
        .createDataFrame([(i, t) for i, _, t in rows], "doc_id long, toxic int")
    )
    models = [toxicity.fit(docs.repartition(n), labels) for n in (1, 7)]
    assert models[0].lexicon.arcs == models[1].lexicon.arcs and models[0].lexicon.arcs
    assert (models[0].weights == models[1].weights).all()
    empty = toxicity.fit(docs.limit(0), labels.limit(0))
    assert {r["score"] for r in toxicity.score(docs.limit(3), empty).collect()} == {0.5}
    assert toxicity.score(docs.limit(0), models[0]).count() == 0


def plain_base(text):
    """The base patterns by hand: leftmost, non-overlapping per kind."""
    value, found, n = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_.=-"), [], len(text)

    def run(i, letters):
        while i < n and text[i] in letters:
            i += 1
        return i

    i = 0
    while i < n:
        end = None
        for name in ("password", "passwd", "secret", "token", "apikey", "api_key"):
            own = text[i : i + len(name)]
            if len(own) == len(name) and all(a == b or (a.isascii() and a.lower() == b) for a, b in zip(own, name)):
                for quoted in (1, 0) if text[i + len(name) : i + len(name) + 1] in ("'", '"') and i + len(name) < n else (0,):
                    k = run(i + len(name) + quoted, " ")
                    if k < n and text[k] in ":=":
                        k = run(k + 1, " ")
                        k += k < n and text[k] in "'\""
                        if run(k, value) > k:
                            end = end or (run(k, value), run(k, value) - k)
        if end:
            if end[1] >= 12:
                found.append((i, 0, f"assign:{i}:{end[0]}"))
            i = end[0]
        else:
            i += 1
    for kind, start, letters, least, order in (("access", "AKIA", set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), 18, 1), ("hex", "", set("0123456789abcdef"), 16, 2)):
        i = 0
        while i < n:
            end = run(i + len(start), letters) if text.startswith(start, i) else i
            if end > i + len(start):
                if end - i >= least:
                    found.append((i, order, f"{kind}:{i}:{end}"))
                i = end
            else:
                i += 1
    return ",".join(x for *_, x in sorted(found))


def test_base_spans_equal_plain_search():
    parts = [
        "password",
        "Passwd",
        "SECRET",
        "token",
        "api_key",
        "apiKey",
        '"',
        "'",
        " ",
        "  ",
        ":",
        "=",
        "==",
        "AKIA",
        "A1B2C3D4E5F6G7H8",
        "0123456789abcdef",
        "deadbeef",
        "x",
        "ſecret",
        "é",
        "abcDEF12345/+_.-=",
        "\n",
    ]
    for _ in range(4000):
        text = "".join(R.choice(parts) for _ in range(R.randint(1, 9)))
        assert secret_scan.joined(secret_scan.base_spans(text)) == plain_base(text), text


#: Lines of other shapes than the training templates; what is between angle brackets is secret.
HELD_OUT = (
    "remember: password for the router was <{short}> until june", "login bob with pass <{signs}>", "new token <{mixed}> was issued", 'config.secret_key = "<{mixed}>"', "her passphrase = <{phrase}>", "psql uses password <{signs}> there", "curl -H 'Authorization: Bearer <{jwt}>' now",
    "deploy with <{github}> please", "charged through <{stripe}> yesterday", "we rotated <{slack}> last week", "my pass is <{short}>", "api key <{google}> leaked", "the token was <{hex12}>", "set TOKEN to <{hex40}>",
    "visit https://docs.{word}.org/{path} soon", "write to {mail} and {mail}", "built from commit {hex40}", "checksum sha256 {hex64} matches", "ticket {digits16} closed on {date}", "ping {ip} failed {number} times", "run {snake} then {camel}", "a token of {word} and {word}", "the secret to {word} bread",
    "{word} forgot their password again {word}", "keys {word} on the table", "released {version} in {year}", "{word} {long} {word} {number}", "fax {phone} or {phone}", "uuid {uuid} stored", "{word}!! {word}!! {WORD}!!", "page {number} of {number}", "key figures {number} and {number}",
)


def held_out_lines(seed, copies):
    r = random.Random(seed)
    for template in HELD_OUT * copies:
        text, secrets = secret_scan.drawn(r, template.replace("<{", "!{").replace("}>", "}"))
        yield text, secrets


def held_out_figures(seed=99, copies=25):
    model = secret_scan.trained()
    reach, hit, found, wanted = model.reach(), 0, 0, 0
    for text, secrets in held_out_lines(seed, copies):
        got = secret_scan.field_spans(text, model, reach)
        hit, found, wanted = hit + len(set(got) & set(secrets)), found + len(got), wanted + len(secrets)
    return hit / max(1, found), hit / wanted


def test_field_on_held_out_lines():
    precision, recall = held_out_figures()
    assert precision > 0.9 and recall > 0.85, (precision, recall)


def test_field_finds_what_the_base_misses(spark):
    texts = [
        "my password is Tr0ub4dor&3xyz here",
        "db pass hunter2secret99 ok",
        "token is 9f8a7b6c5d4e",
        "the passphrase is correcthorsebatterystaple",
        "the secret of the forest is old",
    ]
    got = {r["doc_id"]: r for r in secret_scan.scan_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, value in enumerate(["Tr0ub4dor&3xyz", "hunter2secret99", "9f8a7b6c5d4e", "correcthorsebatterystaple"]):
        at = texts[i].index(value)
        assert got[i]["spans"] == f"crf:{at}:{at + len(value)}"
    assert got[4]["spans"] == ""


def test_stretches_tag_as_whole_lines():
    model = secret_scan.trained()
    assert model.reach() is not None
    lines = list(held_out_lines(5, 4))
    for _ in range(60):
        text = " ".join(prose(R.randint(0, 40)) + " " + R.choice(lines)[0] for _ in range(3))
        assert secret_scan.field_spans(text, model, model.reach()) == secret_scan.field_spans(text, model, None)
        quiet = prose(30) + "\n" + word().title() + "### " + word(12, 20)
        whole = secret_scan.tokens(quiet, 0, quiet.index("\n"))
        scores = model.scores(secret_scan.line_features([quiet[a:b] for a, b in whole], secret_scan.file_features(quiet)))
        assert set(secret_scan.viterbi(scores, model.moves)) == {secret_scan.OUT}


def test_marginals_equal_enumeration():
    r = np.random.default_rng(4)
    moves = np.where(secret_scan._MOVES < 0, secret_scan._MOVES, r.normal(size=(3, 3)))
    emit, there = r.normal(size=(2, 4, 3)), np.array([[True] * 4, [True, True, False, False]])
    tags, pairs = secret_scan.marginals(emit, there, moves)
    wanted_pairs = np.zeros((3, 3))
    for k, n in ((0, 4), (1, 2)):
        every = list(product(range(3), repeat=n))
        weight = np.exp([emit[k, range(n), t].sum() + secret_scan._FIRST[t[0]] + sum(moves[a, b] for a, b in zip(t, t[1:])) for t in every])
        weight /= weight.sum()
        wanted = np.zeros((4, 3))
        for t, w in zip(every, weight):
            wanted[range(n), t] += w
            for a, b in zip(t, t[1:]):
                wanted_pairs[a, b] += w
        assert np.allclose(tags[k], wanted)
    assert np.allclose(pairs, wanted_pairs)


def test_taking_rows_of_the_mix(awkward):
    taken, planned = Counter(r["doc_id"] for r in mixing.take(awkward).collect()), Counter()
    for r in mixing.mix(awkward).collect():
        planned[r["doc_id"]] += r["copies"]
    assert taken == +planned and mixing.take(awkward).columns == awkward.columns
    row = next(r for r in mixing.take(awkward).collect() if r["doc_id"] == 10)
    assert row["text"] == LONG and row["copies"] == 10 and row["rank"] == "x"
    assert mixing.take(awkward.limit(0)).count() == 0


def brute_mix(rows):
    """taken by doc_id, one document after the other; rows are (doc_id, source, words)."""
    by = {}
    for i, s, n in rows:
        by.setdefault(s, []).append((i, n))
    order = sorted((s for s in by if s is not None), key=lambda s: s.encode()) + [None] * (None in by)
    weight = {s: mixing.WEIGHTS[k % len(mixing.WEIGHTS)] for k, s in enumerate(order)}
    size = {s: sum(n for _, n in by[s]) for s in by}
    total, full = sum(size.values()), set()
    while True:
        level = (total - sum(3 * size[s] for s in full)) / (sum(weight[s] for s in by if s not in full) or 1)
        more = {s for s in by if s not in full and 3 * size[s] < level * weight[s]}
        if not more:
            break
        full |= more
    out = {}
    for s, own in by.items():
        target = float(3 * size[s]) if s in full else level * weight[s]
        whole = math.floor(target / size[s]) if size[s] else 0
        part = target - whole * size[s]
        ranked = []
        for i, n in own:
            out[i] = whole * n
            if part > 0 and n:
                u = (int(hashlib.md5(str(i).encode()).hexdigest()[:13], 16) + 0.5) / 2**52
                f = min(mixing.MOST_PART, part / size[s])
                tilt = min(4.0, max(0.25, math.sqrt(size[s] / len(own) / n)))
                ranked.append(((u / (1 - u)) / (f / (1 - f) * tilt), i, n))
        ahead, cut = 0, 0
        for k, (_, _, n) in enumerate(sorted(ranked)):
            if ahead + n / 2 <= part:
                cut = k + 1
            ahead += n
        for _, i, n in sorted(ranked)[:cut]:
            out[i] += n
    return out


def test_mix_equals_brute_force(spark):
    rows = [(i, R.choice([None, "a", "b", "c", "d"]), " ".join("w" * R.randint(0, 30))) for i in range(300)]
    got = {r["doc_id"]: r["taken"] for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()}
    assert got == brute_mix([(i, s, len(t.split())) for i, s, t in rows])


def test_pipeline_stages_on_awkward_and_empty_tables(spark, awkward, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(i, 1, 0) for i in range(12)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for table in (awkward, awkward.limit(0)):
        folder = f"{tmp_path}/{table.count()}"
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, str(tmp_path))
            assert name == "bpe" or out.columns == table.columns, name
            before, after = Counter(r["doc_id"] for r in table.collect()), Counter(r["doc_id"] for r in out.collect())
            assert set(after) <= set(before), name
            if name == "toxicity" or name == "bpe":
                assert after == before, name
            out.write.parquet(f"{folder}/{name}")
            table = spark.read.parquet(f"{folder}/{name}")
