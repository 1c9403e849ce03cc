"""The ten corpus operators against plain versions, and on odd tables: nulls, empty, long, repeated, clashing columns."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from factloom.llm import common, exactdedup, langid, licenses, media, mixing, neardup, packing, pfp, quality, tokencount
from factloom.llm import queries as Q

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")

WORDS = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa", "lamda", "mu", "Straße", "élan", "niño"]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", ".", ",", "\n"]) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Documents with every oddity, and columns whose names the operators use inside."""
    rng = random.Random(1)
    base = prose(rng, 300)
    near = base.split(" ")
    near[150] = "CHANGED"
    texts = [None, "", "", " \n\t", "a", "A", "one two three four", "ONE two three four", base, base.upper().replace("SS", "ss"), base, " ".join(near), base + " tail", prose(rng, 40_000), "x" * 3000, "x" * 3000 + "y", "\x1c odd \x85 <|endoftext|>   space", "Licensed under CC BY-NC 4.0", "日本語のテキスト " * 90, "ab " * 700, "mit license MIT LICENSE", "é \U0001f600 " * 50]
    rows = [(i * 7 % 101, t, rng.choice(["en", "de", None]), rng.choice(["src0", "src1", None]), i, -i, "k", i, 0.5, None) for i, t in enumerate(texts)]
    rows += [rows[8], rows[8], (None, base, "en", None, 1, 1, None, 1, None, None), (None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, node long, name string, level int, score double, regs binary")


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


def table(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def folded(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# 1 packing


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_packing(which, request):
    df = request.getfixturevalue(which)
    got = packing.pack(df, BPE, checksum=True).collect()
    tok = Tokenizer.from_file(BPE)
    want = collections.Counter()
    for i, t in table(df):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        want[i, len(ids), tuple(ids)] += 1
    ids_of = collections.defaultdict(list)
    for k in want:
        ids_of[k[0], k[1]].append(k[2])
    for r in got:
        assert any(packing.crc_of(list(ids[r.start : r.start + r.length])) == r.ids_crc32 for ids in ids_of[r.doc_id, r.doc_tokens])
    assert sum(r.length for r in got) == sum(k[1] * n for k, n in want.items())
    places = sorted((r.sequence_id, r.offset, r.length) for r in got)
    at = 0
    for s, o, n in places:
        assert s * 2048 + o == at and o + n <= 2048
        at += n
    ids = packing.pack(df, BPE).collect()
    assert sum(len(r.ids) for r in ids) == 4 * at


def test_packing_empty(empty):
    assert packing.pack(empty, BPE).collect() == []


def test_encoder_is_the_tokenizer():
    rng = random.Random(3)
    tok, encode = Tokenizer.from_file(BPE), packing.encoder(BPE)
    alphabet = " \n\t'abcSTREVMLLdé0²_-.,!\x85\x1cßñ日🙂 ΣѢ"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(3000)] + ["it's we'll\n\n  x ", "<|endoftext|>"]
    for t, raw in zip(texts, encode(texts)):
        assert np.frombuffer(raw, encode.dtype).tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)


# 2 near dedup


def brute_components(rows):
    sets = []
    for _, t in rows:
        w = folded(t).encode().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
            parent[find(a)] = find(b)
    low = {}
    for i, (k, _) in enumerate(rows):
        if k is not None and (low.get(find(i)) is None or k < low[find(i)]):
            low[find(i)] = k
    return collections.Counter((rows[i][0], len(sets[i]), low.get(find(i))) for i in range(len(rows)))


def test_near_dedup_small(docs):
    got = neardup.groups(docs).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(table(docs))
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_dedup_odd(odd):
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in neardup.groups(odd).collect())
    want = brute_components(table(odd))
    # a set-less row with a doc_id stands with its doc_id
    assert got == want


def test_near_dedup_empty(empty):
    assert neardup.groups(empty).collect() == []


@pytest.mark.parametrize("changes", [2, 6, 12])
def test_near_dedup_template(spark, changes):
    """Many variants of one text at about the threshold, more than a small group holds."""
    rng = random.Random(changes)
    base = [f"w{i}" for i in range(400)]
    rows = []
    for k in range(120):
        w = list(base)
        for p in rng.sample(range(400), rng.randrange(changes + 1)):
            w[p] = f"x{k}-{p}"
        rows.append((k, " ".join(w)))
    got = neardup.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows)


def test_near_dedup_keeps_one(odd):
    kept = neardup.dedup(odd)
    assert kept.columns == odd.columns
    groups = {r.component_id for r in neardup.groups(odd).collect()}
    assert {r.doc_id for r in kept.collect()} == groups and kept.count() == len(groups)


def test_dedup_keeps_columns_of_any_name(spark):
    """Columns named as the operators' own stay as they are."""
    names = ["sha", "key", "sha2", "__sha", "root", "node", "head", "twin", "n", "name", "level", "core", "topic", "weight", "probability", "source_class"]
    rows = [(1, "Some Text", "en", "src0", *range(len(names))), (1, "other text of these words", "en", "src0", *range(len(names))), (2, "some text", "de", "x", *range(5, 5 + len(names)))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"{x} int" for x in names))
    for out, ids in ((exactdedup.dedup(df), [1, 2]), (neardup.dedup(df), [1, 1])):
        assert out.columns == df.columns
        got = out.collect()
        assert sorted(r.doc_id for r in got) == ids
        assert all(tuple(r) in rows for r in got)
    kept = mixing.sample(df)
    assert kept.columns == df.columns and all(tuple(r) in rows for r in kept.collect())


def test_classes_have_all_bits(spark, monkeypatch):
    """Sets whose identities share one half stay apart."""
    real = neardup.xxhash.xxh3_128_digest
    monkeypatch.setattr(neardup.xxhash, "xxh3_128_digest", lambda x: b"12345678" + real(x)[8:])
    rows = [(1, "a b c d e f"), (2, "g h i j k l"), (3, "A B C D E F"), (4, "m n o")]
    own, nodes, roots = neardup.link(spark.createDataFrame(rows, "doc_id long, text string"))
    assert nodes.count() == nodes.select("node").distinct().count() == nodes.select("head", "twin").distinct().count()


def test_near_dedup_keeps_unlike_texts(spark):
    """One doc_id for two unlike texts, unlike texts without one, and near copies across them."""
    rng = random.Random(11)
    a, b, c, d, e = ([f"{rng.randrange(10**6)}" for _ in range(200)] for _ in range(5))
    near = lambda w: " ".join([*w[:100], "changed", *w[101:]])
    a, b, c, d, e = map(" ".join, (a, b, c, d, e))
    rows = [(1, a), (1, b), (2, near(b.split())), (None, c), (None, c), (None, d), (None, e), (3, near(e.split())), (None, None), (None, ""), (None, " "), (4, ""), (4, "\n")]
    got = collections.Counter(table(neardup.dedup(spark.createDataFrame(rows, "doc_id long, text string"))))
    blank = {k: n for k, n in got.items() if not (k[1] or "").strip()}
    assert {k: n for k, n in got.items() if k not in blank} == {(1, a): 1, (1, b): 1, (None, c): 1, (None, d): 1, (3, near(e.split())): 1}
    assert sorted((str(i), t or "") for i, t in blank) == [("4", ""), ("4", "\n"), ("None", ""), ("None", " ")] and set(blank.values()) == {1}


def test_near_dedup_at_80(spark):
    """Pairs of Jaccard 0.72 to 0.90: a caller's threshold of 80 links those from 0.80, each alone."""
    rows, low = [], {80: [], 85: []}
    for k, changes in enumerate([4, 6, 7, 8, 9, 10, 12]):
        w = [f"w{k}-{i}" for i in range(400)]
        x = [f"x{i}" if i % 25 == 12 and i // 25 < changes else v for i, v in enumerate(w)]
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(x))]
        a, b = ({tuple(v[i : i + 5]) for i in range(396)} for v in (w, x))
        for percent in low:
            low[percent] += [2 * k, 2 * k if 100 * len(a & b) >= percent * len(a | b) else 2 * k + 1]
    assert low[80] != low[85]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for percent in low:
        got = sorted((r.doc_id, r.component_id) for r in neardup.groups(df, percent).collect())
        assert [c for _, c in got] == low[percent]
        assert sorted(r.doc_id for r in neardup.dedup(df, percent).collect()) == sorted(set(low[percent]))


def test_bands_follow_the_threshold():
    assert (neardup.bands_for(85), neardup.least_for(85)) == (neardup.BANDS, 0.69)
    for percent in (50, 70, 80, 90, 95):
        assert (1 - (percent / 100) ** neardup.ROWS) ** neardup.bands_for(percent) <= neardup.MISS


def test_estimate_is_close():
    rng = np.random.default_rng(5)
    for j in (0.5, 0.85):
        errors = []
        for _ in range(60):
            x = rng.integers(0, 1 << 63, 1000, dtype=np.uint64) * np.uint64(2)
            k = int(1000 * 2 * j / (1 + j))
            a, b = x, np.concatenate([x[:k], rng.integers(0, 1 << 63, 1000 - k, dtype=np.uint64) * np.uint64(2)])
            r = [neardup.registers(neardup.minima(np.sort(v)))[None] for v in (a, b)]
            errors.append(neardup.likely(*r, np.array([1000.0]), np.array([1000.0]))[0] - k / (2000 - k))
        assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 1.5 * np.sqrt(j * (1 - j) / neardup.M)


def test_sketches_merge():
    rng = np.random.default_rng(6)
    a, b = (rng.integers(0, 1 << 63, 500, dtype=np.uint64) for _ in range(2))
    both = neardup.minima(np.unique(np.concatenate([a, b])))
    assert (np.minimum(neardup.minima(a), neardup.minima(b)) == both).all()
    assert (np.maximum(*(neardup.registers(neardup.minima(x)) for x in (a, b))) == neardup.registers(both)).all()


# 3 quality


def test_quality_learns(spark, data):
    out = Q.op3_quality_classifier(spark, data.replace("0.001", "0.01"))
    labels = spark.read.parquet(data.replace("0.001", "0.01") + "/labels.parquet")
    got = out.join(labels, "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert np.mean([r.predicted == r.quality for r in held]) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)


def plain_score(model, raw):
    """The score of one text, passage by passage, with plain loops."""
    passages = [raw[i : i + quality.PASSAGE] for i in range(0, len(raw), quality.PASSAGE)] or [b""]
    kinds = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".", ",", "!?", "|", "#", "$", "%", "&", "*", "-_=+", "<>{}[]()/\\", "\"'`;:"]
    vectors, before = [], set()
    for passage in passages:
        n = max(1, len(passage))
        shares = [sum(chr(b) in k for b in passage) / n for k in kinds] + [sum(b >= 128 for b in passage) / n]
        other = (len(passage) - round(sum(shares) * n)) / n
        words, lines = passage.split(), passage.split(b"\n")
        own, m = set(words), max(1, len(words))
        more = [len(own) / m, sum(a == b for a, b in zip(words, words[1:])) / m, len(own & before) / max(1, len(own)), len(words) / 64, sum(map(len, own)) / max(1, len(own)) / 10, max(map(len, words), default=0) / 40, len(set(lines)) / len(lines), n / quality.PASSAGE]
        before = own
        x = [min(8, max(-8, (v - a) / s)) for v, a, s in zip([other, *shares, *more], model.mean, model.scale)]
        vectors.append([math.tanh(sum(x[i] * model.p["E"][i][j] for i in range(len(x))) + model.p["e"][j]) for j in range(quality.WIDTH)])
    gates = []
    for h in vectors:
        t = [math.tanh(sum(h[i] * model.p["V"][i][g] for i in range(quality.WIDTH))) for g in range(quality.GATE)]
        u = [1 / (1 + math.exp(-sum(h[i] * model.p["U"][i][g] for i in range(quality.WIDTH)))) for g in range(quality.GATE)]
        gates.append(math.exp(sum(a * b * w for a, b, w in zip(t, u, model.p["w"]))))
    z = [sum(g * h[j] for g, h in zip(gates, vectors)) / sum(gates) for j in range(quality.WIDTH)]
    return 1 / (1 + math.exp(-sum(a * b for a, b in zip(z, model.p["c"])) - model.p["d"]))


def test_quality_equals_plain_scores(spark, data, docs, odd):
    """op3's scores, and those of odd texts, are those of the plain version with the same parameters."""
    labels = spark.read.parquet(f"{data}/labels.parquet")
    model = quality.train(docs, labels, Q._rest(4) != 2)
    got = {r.doc_id: r.score for r in Q.op3_quality_classifier(spark, data).collect()}
    rows = table(docs)
    assert set(got) == {k for k, _ in rows}
    for k, t in rows:
        assert abs(got[k] - plain_score(model, (t or "").encode())) < 1e-5
    want = collections.Counter((k, round(plain_score(model, (t or "").encode()), 4)) for k, t in table(odd))
    assert collections.Counter((r.doc_id, round(r.score, 4)) for r in quality.score(odd, model).collect()) == want


def test_quality_of_repeated_ids(spark):
    """Of several texts with one doc_id training takes the smallest, whatever the order of the rows."""
    rng = random.Random(7)
    rows = [(k, prose(rng, 60) if k % 2 else "Ea " * rng.randrange(20, 90)) for k in range(40)] + [(k, prose(rng, 20)) for k in range(40)]
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(40)], "doc_id long, quality int, toxic int")
    models = []
    for _ in range(2):
        rng.shuffle(rows)
        models.append(quality.train(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), labels, F.lit(True)))
    assert all((models[0].p[k] == models[1].p[k]).all() for k in models[0].p)


def test_quality_odd(spark, odd, empty):
    labels = spark.createDataFrame([(7, 1, 0), (7, 0, 0), (14, None, 0), (None, 1, 0), (999, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(odd, labels, F.lit(True))
    assert model.p is None and model.share == 1.0
    rng = random.Random(2)
    good, bad = [prose(rng, 90) for _ in range(40)], ["Ea " * rng.randrange(20, 90) for _ in range(40)]
    model = quality.fit([t.encode() for t in good + bad], [1] * 40 + [0] * 40)
    assert quality.score(odd, model).count() == odd.count()
    assert quality.score(empty, model).collect() == []
    kept = quality.keep_good(odd, model)
    assert kept.columns == odd.columns
    scores = {(r.doc_id, r.score) for r in quality.score(odd, model).collect()}
    assert collections.Counter(r.doc_id for r in kept.collect())[None] <= 2
    assert {r.doc_id for r in kept.collect()} == {k for k, s in scores if s >= quality.LIMIT}
    first, weights = model.score([quality.encode(b""), quality.encode(good[0].encode() * 20)])
    assert len(first) == 2 and abs(weights[1:].sum() - 1) < 1e-6


def test_quality_gradient():
    rng = np.random.default_rng(1)
    p = {"E": rng.normal(size=(quality.SIZE, 4)), "e": rng.normal(size=4), "V": rng.normal(size=(4, 3)), "U": rng.normal(size=(4, 3)), "w": rng.normal(size=3), "c": rng.normal(size=4), "d": np.float64(0.1)}
    x, sizes, y = rng.normal(size=(7, quality.SIZE)), np.array([3, 1, 3]), np.array([1.0, 0, 1])
    loss = lambda q: -np.mean(np.log(np.where(y == 1, s := quality._forward(q, x, sizes)[0], 1 - s)))
    g = quality._gradients(p, x, sizes, y, np.full(3, 1 / 3))
    for k in p:
        flat = np.atleast_1d(p[k]).copy()
        i = tuple(rng.integers(0, n) for n in flat.shape)
        step = 1e-5
        up, down = flat.copy(), flat.copy()
        up[i] += step
        down[i] -= step
        shape = np.shape(p[k])
        slope = (loss(p | {k: up.reshape(shape)}) - loss(p | {k: down.reshape(shape)})) / (2 * step)
        assert abs(slope - np.atleast_1d(g[k])[i]) < 1e-6


# 4 exact dedup


def brute_exact(rows):
    groups = collections.defaultdict(list)
    for k, t in rows:
        groups[folded(t)].append(k)
    out = collections.Counter()
    for t, ks in groups.items():
        top = max((k for k in ks if k is not None), default=None)
        for k in ks:
            out[k, top, len(ks), k == top, hashlib.sha256(t.encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("which,block", [("odd", 4096), ("odd", 16), ("docs", 64)])
def test_exact_dedup(which, block, request):
    df = request.getfixturevalue(which)
    got = collections.Counter(tuple(r) for r in exactdedup.groups(df, block).collect())
    assert got == brute_exact(table(df))


def test_exact_dedup_shared_hash(odd, monkeypatch):
    """Blocks that share a hash are named by content."""
    real = F.xxhash64
    monkeypatch.setattr(exactdedup.F, "xxhash64", lambda *c: F.pmod(real(*c), F.lit(3)))
    got = collections.Counter(tuple(r) for r in exactdedup.groups(odd, 512).collect())
    assert got == brute_exact(table(odd))


def test_exact_dedup_keeps_one(odd, empty):
    kept = exactdedup.dedup(odd)
    assert kept.columns == odd.columns
    want = {(k, sha) for k, top, _, keep, sha in brute_exact(table(odd)) if keep}
    assert collections.Counter((r.doc_id, hashlib.sha256(folded(r.text).encode()).hexdigest()) for r in kept.collect()) == collections.Counter(want)
    assert exactdedup.groups(empty).collect() == [] and exactdedup.dedup(empty).collect() == []


# 5 media


def test_media_round_trip(odd, empty):
    got = sorted((r.doc_id is not None, r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in media.digest(media.to_media(odd)).collect())
    want = []
    for k, t in table(odd):
        raw = (t or "").encode()
        full = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        want.append((k is not None, k, len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:])))
    assert got == sorted(want)
    assert media.digest(media.to_media(empty)).collect() == []


def test_media_features(spark):
    payload = bytes(range(256)) * 9 * 64
    blob = media.write_container(payload)
    rows = [(1, blob), (2, blob[:-1]), (3, b"nothing"), (4, None), (5, b"")]
    out = {r.id: r for r in media.inspect(spark.createDataFrame(rows, "id int, media binary")).collect()}
    r = out[1]
    assert (r.codec.strip(), r.width, r.height, r.n_samples, r.duration_ms, r.error) == ("raw", 24, 24, 256, 10240, None)
    assert b"".join(blob[c.start : c.start + c.length] for c in r.chunks) == payload
    assert [blob[k.start : k.start + k.length] for k in r.keyframes] == [payload[576 * i : 576 * (i + 1)] for i in range(0, 256, 12)]
    assert all(out[i].error and out[i].codec is None for i in (2, 3, 4, 5))
    clash = media.inspect(spark.createDataFrame([("mine", blob, 1)], "Codec string, media binary, error int")).collect()[0]
    assert (clash.Codec, clash.codec_.strip(), clash.error, clash.error_) == ("mine", "raw", 1, None)


def test_media_never_crashes():
    rng, blob = random.Random(4), media.write_container(bytes(576 * 70))
    for _ in range(2000):
        b = bytearray(blob)
        for _ in range(rng.randrange(1, 4)):
            b[rng.randrange(700)] = rng.randrange(256)
        try:
            media.read_container(bytes(b[: rng.choice([len(b), rng.randrange(len(b))])]))
        except ValueError:
            pass


# 6 licenses


def test_licenses(odd, empty):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    got = collections.Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.digest(licenses.scan(odd)).collect())
    want = collections.Counter()
    for k, t in table(odd):
        words = word.findall(folded(t))
        places = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        at = [i for i, _ in places]
        want[k, len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({b for _, b in places}))] += 1
    assert got == want
    assert licenses.digest(licenses.scan(empty)).collect() == []


def plain_accepts(template, words):
    """The farthest end of a reading of a template's words from the first word on, by recursion over its marks."""
    marks = re.findall(r"\[\[|\]\]|\{\{[^}]*\}\}|[^\s\[\]{}]+", template)

    def tree(i):
        out = []
        while i < len(marks) and marks[i] != "]]":
            if marks[i] == "[[":
                inner, i = tree(i + 1)
                out.append(inner)
            else:
                out.append(marks[i])
            i += 1
        return out, i

    def ends(items, at):
        if not items:
            return {at}
        first, rest = items[0], items[1:]
        if isinstance(first, list):
            stops = {at} | ends(first, at)
        elif first.startswith("{{"):
            parts = first[2:-2].split(":", 3)
            stops, k = set(), at
            while k - at <= int(parts[2]):
                if k - at >= int(parts[1]):
                    stops.add(k)
                if k >= len(words) or len(parts) > 3 and not re.fullmatch(parts[3], words[k]):
                    break
                k += 1
        else:
            own = licenses.words_of(first.encode())
            own = [w.decode() for w in own]
            stops = {at + len(own)} if words[at : at + len(own)] == own else set()
        return set().union(*(ends(rest, s) for s in stops)) if stops else set()

    return max(ends(tree(0)[0], 0), default=-1)


def test_automata_equal_plain_reading():
    rng = random.Random(12)
    for template in ("a [[b [[c]]]] d", "a {{x:0:2}} b [[c {{y:1:1:[0-9]+}}]] d", "[[a]] b [[c]] a {{z:1:3}} d"):
        machine = licenses.compile_template(template)
        for _ in range(1500):
            words = [rng.choice(["a", "b", "c", "d", "7"]) for _ in range(rng.randrange(8))]
            want = plain_accepts(template, words)
            assert machine.run([w.encode() for w in words], 0) == (want if want > 0 else -1), (template, words)


def test_license_labels_and_score(spark):
    """labels and score against places found word by word."""
    rng = random.Random(13)
    texts = []
    for _ in range(60):
        parts = [prose(rng, rng.randrange(30))]
        for _ in range(rng.randrange(4)):
            text = rng.choice([*licenses.TEMPLATES.values(), *licenses.PHRASES])
            text = re.sub(r"\{\{[^}]*\}\}", "2024", re.sub(r"\[\[|\]\]", "", text))
            parts += [text if rng.random() < 0.8 else text[len(text) // 3 :], prose(rng, rng.randrange(30))]
        texts.append(" ".join(parts))
    got = {r.doc_id: r for r in licenses.digest(licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()}
    seen = set()
    for i, t in enumerate(texts):
        words = [w.decode() for w in licenses.words_of(t.encode())]
        covered, labels = set(), set()
        for phrase, label in licenses.PHRASES.items():
            n = len(phrase.split())
            for at in range(len(words)):
                if words[at : at + n] == phrase.split():
                    covered.update(range(at, at + n))
                    labels.add(label)
        for label, template in licenses.TEMPLATES.items():
            end = 0
            first = {w.decode() for w in licenses.words_of(re.sub(r"\{\{[^}]*\}\}|\[\[|\]\]", " ", template).encode())}
            for at in range(len(words)):
                if at >= end and words[at] in first and (stop := plain_accepts(template, words[at : at + 400])) > 0:
                    covered.update(range(at, at + stop))
                    labels.add(label)
                    end = at + stop
        seen |= labels
        assert got[i].labels == ",".join(sorted(labels)) and abs(got[i].score - len(covered) / len(words)) < 1e-9, i
    assert len(seen) > 5


def test_templates():
    run = lambda template, text: licenses.compile_template(template).run(licenses.words_of(text.encode()), 0)
    assert run("a [[b [[c]]]] d", "A b c d e") == 4
    assert run("a [[b [[c]]]] d", "a d") == 2
    assert run("a [[b [[c]]]] d", "a c d") == -1
    assert run("by {{who:1:3}} here", "by one two three here") == 5
    assert run("by {{who:1:3}} here", "by here") == -1
    assert run("v {{n:1:1:[0-9]+}}", "v 12") == 2 and run("v {{n:1:1:[0-9]+}}", "v x") == -1
    for bad in ("a ]]", "[[ a", "{{x}}"):
        with pytest.raises(ValueError):
            licenses.compile_template(bad)
    scanner = licenses.Scanner()
    text = "x " + licenses.TEMPLATES["mit-text"].replace("[[including the next paragraph]]", "") + " y"
    assert "mit-text" in {label for _, _, label in scanner.scan(text.encode())[2]}
    assert "mit-text" not in {label for _, _, label in scanner.scan(text.replace("sublicense", "relicense").encode())[2]}


# 7 substring dedup


def brute_cut(rows, length=400):
    seen = collections.Counter()
    raws = [(k, (t or "").encode()) for k, t in rows]
    for _, b in raws:
        seen.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = collections.Counter()
    for k, b in raws:
        gone = np.zeros(len(b) + 1, int)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        cut = np.cumsum(gone)[: len(b)] > 0
        spans = int((np.diff(np.concatenate(([0], cut.astype(int)))) == 1).sum())
        out[k, len(b), int(cut.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~cut].tobytes()).hexdigest()] += 1
    return out


def small(df):
    return df.where("text is null or length(text) < 50000")


def test_substrings_odd(odd):
    df = small(odd)
    assert collections.Counter(tuple(r) for r in pfp.digest(pfp.dedup(df)).collect()) == brute_cut(table(df))


def test_substrings_planted(spark):
    """Passages of lengths about the limit, shifted, nested, overlapping, in periodic and in plain text."""
    rng = random.Random(9)
    letters = "abcdefghij \n"
    text = lambda n: "".join(rng.choice(letters) for _ in range(n))
    passages = [text(n) for n in (399, 400, 401, 700, 1500)]
    rows = [(i, text(rng.randrange(900)) + rng.choice(passages) + text(rng.randrange(900)) + rng.choice(passages)[rng.randrange(90) :] + text(rng.randrange(50))) for i in range(60)]
    rows += [(100, "ab" * 500), (101, "ab" * 450 + "c" + "ab" * 450), (102, "z" * 400), (103, "z" * 399 + "y"), (104, "q" * 800), (105, passages[4][:800] + passages[4][700:])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert collections.Counter(tuple(r) for r in pfp.digest(pfp.dedup(df)).collect()) == brute_cut(rows)


def test_substrings_of_many_variants(spark):
    """One passage in many contexts with edits at random places: ends of matches in every position, over many ranges."""
    rng = random.Random(10)
    letters = "abcdefghij \n"
    text = lambda n: "".join(rng.choice(letters) for _ in range(n))
    base, rows = text(1400), []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = rng.choice("XYZ")
        a, b = sorted(rng.randrange(len(w)) for _ in range(2))
        rows.append((i, text(rng.randrange(80)) + "".join(w[a:b]) + text(rng.randrange(80))))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert collections.Counter(tuple(r) for r in pfp.digest(pfp.dedup(df)).collect()) == brute_cut(rows)


def test_shared_bytes():
    rng = random.Random(4)
    for _ in range(500):
        x, y = (bytes(rng.randrange(3) for _ in range(rng.randrange(9))) for _ in range(2))
        want = next((i for i, (a, b) in enumerate(zip(x, y)) if a != b), min(len(x), len(y)))
        assert pfp.shared(x, y) == want


def test_substrings_empty(empty):
    assert pfp.digest(pfp.dedup(empty)).collect() == []


def test_triggers_depend_on_the_string_alone():
    rng = random.Random(2)
    core = bytes(rng.randrange(256) for _ in range(400))
    offsets = set()
    for _ in range(20):
        left = bytes(rng.randrange(256) for _ in range(rng.randrange(600)))
        raw = left + core + bytes(rng.randrange(256) for _ in range(rng.randrange(600)))
        a, low, high = pfp.triggers(raw)
        i = np.flatnonzero((low <= len(left)) & (len(left) <= high))
        assert len(i) == 1
        offsets.add(int(a[i[0]]) - len(left))
    assert len(offsets) == 1


# 8 mixing


def test_mixing_marginals(docs):
    got = mixing.weights(docs).collect()
    assert len(got) == docs.count()
    total = sum(r.tokens * r.weight for r in got)
    for i, name in enumerate(("source_class", "lang_class", "topic")):
        share = collections.Counter()
        for r in got:
            share[r[name]] += r.tokens * r.weight / total
        there = sum(mixing.TARGETS[i][c] for c in share)
        for c, s in share.items():
            assert abs(s - mixing.TARGETS[i][c] / there) < 1e-2
    tokens = sum(r.tokens for r in got)
    assert abs(sum(r.tokens * r.probability for r in got) / tokens - mixing.KEEP) < 1e-6
    assert all(0 <= r.probability <= 1 for r in got)
    assert {r.doc_id for r in mixing.sample(docs).collect()} == {r.doc_id for r in got if r.kept}


def test_mixing_odd(odd, empty):
    got = mixing.weights(odd).collect()
    assert len(got) == odd.count() and all(r.tokens >= 1 for r in got)
    kept = mixing.sample(odd)
    assert kept.columns == odd.columns
    assert collections.Counter(r.doc_id for r in kept.collect()) == collections.Counter(r.doc_id for r in got if r.kept)
    assert mixing.weights(empty).collect() == [] and mixing.sample(empty).collect() == []
    assert "Python" not in mixing.weights(odd)._jdf.queryExecution().executedPlan().toString()


def test_topics_and_tokens(spark):
    """Topics and tokens by plain counting."""
    texts = [None, "", " \n", "plain words, here.", "licensed as is", "a | b | c", "me@x.org", "word " * 100 + "license", "LICENSE Copyright warranty | ", "Straße 日本 x1 --", "+1 (2) see http://a"]
    got = {r.doc_id: r for r in mixing.classed(spark.createDataFrame([(i, t, None, None) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")).collect()}
    for i, t in enumerate(texts):
        tokens = 1 + sum(c in mixing.SIGNS for c in t or "")
        counts = {k: sum((t or "").count(m) for m in marks) for k, marks in mixing.MARKS.items()}
        topic = max(counts, key=counts.get)
        assert (got[i].tokens, got[i].topic) == (tokens, topic if counts[topic] * mixing.RATE >= tokens else "prose"), t


def test_rake():
    cells = {("a", "x", "p"): 10.0, ("a", "y", "p"): 30.0, ("b", "x", "p"): 40.0, ("b", "y", "p"): 20.0}
    got = mixing.rake(cells, ({"a": 0.5, "b": 0.5}, {"x": 0.2, "y": 0.8}, {"p": 1.0}))
    assert abs(sum(v for k, v in got.items() if k[0] == "a") - 0.5) < 1e-9
    assert abs(sum(v for k, v in got.items() if k[1] == "x") - 0.2) < 1e-9
    odds = lambda t: t["a", "x", "p"] * t["b", "y", "p"] / (t["a", "y", "p"] * t["b", "x", "p"])
    assert abs(odds(got) - odds(cells)) < 1e-9


# 9 language


def test_language_learns(spark, data):
    folder = data.replace("0.001", "0.01")
    out = Q.op9_language_id(spark, folder).join(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.97


def test_language_odd(odd, empty):
    model = langid.train(odd, F.lit(True))
    assert model.langs == ["de", "en"]
    got = langid.identify(odd, model).collect()
    assert len(got) == odd.count()
    blank = {k for k, t in table(odd) if not any(map(str.isalpha, t or ""))}
    lettered = {(k, any(map(str.isalpha, t or ""))) for k, t in table(odd)}
    for r in got:
        assert (r.doc_id, r.lang_pred != "und") in lettered
    assert {r.doc_id for r in got if r.lang_pred == "und"} == blank
    assert all(0 <= r.score <= 1 for r in got)
    assert langid.identify(empty, langid.train(empty, F.lit(True))).collect() == []
    alone = langid.train(odd.withColumn("lang", F.lit("xx")), F.lit(True))
    assert {r.lang_pred for r in langid.identify(odd, alone).collect()} == {"xx", "und"}


def plain_language(model, text):
    """Language and score of one text, with dicts and plain loops."""
    kept = "".join(chr(b) if 97 <= b <= 122 or b >= 128 else chr(b + 32) if 65 <= b <= 90 else " " for b in text.encode())
    raw = [ord(c) for c in " " + " ".join(x for x in kept.split(" ") if x) + " "]
    cut, counts, half = (1 << 32) - 1, collections.Counter(), langid.BUCKETS // 2
    place = lambda v: ((v ^ v >> 15) * 0x2C1B3C6D & cut) >> 20
    two = [(a * 0x9E3779B1 + b * 0x85EBCA6B) & cut for a, b in zip(raw, raw[1:])]
    for v in two:
        counts[place(v)] += 1
    for v, c in zip(two, raw[2:]):
        counts[half + place(v ^ (c * 0xC2B2AE35 + 0x27D4EB2F) & cut)] += 1
    norm = math.sqrt(sum(counts.values()))
    margins = [sum(math.sqrt(n) / norm * float(model.w[i][b]) for i, n in counts.items()) + float(model.c[b]) for b in range(model.code.shape[1])]
    losses = [sum(float(t) * math.log1p(math.exp(-m * c)) for t, m, c in zip(model.trust, margins, code)) for code in model.code]
    best = min(range(len(losses)), key=losses.__getitem__)
    return model.langs[best], 1 / sum(math.exp(losses[best] - x) for x in losses)


def test_language_equals_plain_decoding(spark, data, docs):
    """op9's predictions and scores are those of the plain version with the same parameters."""
    model = langid.train(docs, Q._rest(5) != 0)
    got = {r.doc_id: r for r in Q.op9_language_id(spark, data).collect()}
    rows = table(docs)
    assert set(got) == {k for k, _ in rows}
    for k, t in rows:
        want = plain_language(model, t) if any(map(str.isalpha, t or "")) else ("und", 0.0)
        assert got[k].lang_pred == want[0] and abs(got[k].score - want[1]) < 1e-4


def test_every_language_is_learned(spark):
    """600 languages of own letters, one of them hot: all are in the model, and most texts of them are told apart."""
    rng = random.Random(20)
    words = {i: ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(4)] for i in range(600)}
    rows = [(k, " ".join(rng.choice(words[k % 600 if k < 4800 else 0]) for _ in range(12)), f"l{k % 600 if k < 4800 else 0}") for k in range(7000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df, F.lit(True))
    assert set(model.langs) == {v for _, _, v in rows}
    said = {r.doc_id: r.lang_pred for r in langid.identify(df.where("doc_id < 600"), model).collect()}
    assert np.mean([said[k] == v for k, _, v in rows[:600]]) > 0.9


@pytest.mark.parametrize("k", [2, 4, 7, 9, 30])
def test_codewords(k):
    code = langid.codewords(k)
    assert len(np.unique(code, axis=0)) == k
    assert (np.abs(code.sum(0)) < k).all()
    least = min((code[i] != code[j]).sum() for i, j in itertools.combinations(range(k), 2))
    assert least >= (1 if k == 2 else 2)


def test_decoding_corrects_a_bit():
    code = langid.codewords(4)
    model = langid.Model(list("abcd"), code, np.eye(code.shape[1]) * 3, np.zeros(code.shape[1]), np.ones(code.shape[1]))
    for i in range(4):
        for b in range(code.shape[1]):
            x = code[i].copy()
            x[b] *= -1
            assert model.decode(x[None])[0][0] == i


# 10 token counts


def brute_segment(word, scores, unknown):
    marked, longest = tokencount.MARK + word, max(map(len, scores))
    best = [(0.0, 0)]
    for end in range(1, len(marked) + 1):
        options = [(best[end - 1][0] + unknown, best[end - 1][1] - 1)]
        options += [(best[s][0] + scores[marked[s:end]], best[s][1] - 1) for s in range(max(0, end - longest), end) if marked[s:end] in scores]
        best.append(max(options))
    return -best[-1][1], best[-1][0]


def test_token_counts(odd, empty):
    pieces = tokencount.Pieces.load(PIECES)
    got = collections.Counter((r.doc_id, r.n_pretokens, r.n_tokens, round(r.score, 3)) for r in tokencount.count_tokens(odd, PIECES).collect())
    want, known = collections.Counter(), {}
    for k, t in table(odd):
        words = (t or "").split()
        for w in set(words) - known.keys():
            known[w] = brute_segment(w, pieces.scores, pieces.unknown)
        want[k, len(words), sum(known[w][0] for w in words), round(math.fsum(known[w][1] for w in words), 3)] += 1
    assert got == want
    assert max(map(len, known)) >= 3000
    assert tokencount.count_tokens(empty, PIECES).collect() == []


def test_trie_equals_plain_segmentation():
    rng = random.Random(8)
    scores = {"▁": -3.0, "▁a": -1.0, "a": -2.0, "ab": -2.5, "b": -1.5, "abc": -3.0, "c": -4.0, "bc": -2.0}
    pieces = tokencount.Pieces(scores)
    words = {"".join(rng.choice("abcd") for _ in range(rng.randrange(1, 9))) for _ in range(400)}
    for part in (sorted(words)[:100], sorted(words, reverse=True)):
        pieces.learn(part)
    for w in words:
        assert pieces.known[w] == brute_segment(w, scores, pieces.unknown)


# pipeline and frame


def test_pipeline(spark, data):
    folder = data
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{folder}/labels.parquet"), F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) != 2)
    rows = [r for r in docs.collect() if round(float(model.score([quality.encode(r.text.encode())])[0][0]), 9) >= quality.LIMIT]
    exact = brute_exact([(r.doc_id, r.text) for r in rows])
    keep = {k for k, top, _, kept, _ in exact if kept}
    rows = [r for r in rows if r.doc_id in keep]
    least = {k: low for k, _, low in brute_components([(r.doc_id, r.text) for r in rows])}
    rows = [r for r in rows if least[r.doc_id] == r.doc_id]
    kept = spark.createDataFrame(rows, docs.schema)
    mixed = {r.doc_id: r.text for r in mixing.sample(kept).collect()}
    got = corpus_pipeline.run(spark, folder).collect()
    tok = Tokenizer.from_file(BPE)
    assert {r.doc_id for r in got} == set(mixed)
    for k, text in mixed.items():
        ids = tok.encode(text, add_special_tokens=False).ids + [1]
        pieces = sorted((r.start, bytes(r.ids)) for r in got if r.doc_id == k)
        assert b"".join(p for _, p in pieces) == np.array(ids, "<u4").tobytes()


def test_stages_keep_the_columns(spark, data, docs):
    rows = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = common.materialise(stage(spark, rows, data), name)
        assert rows.columns == docs.columns


def test_native_plans(docs):
    for df in (exactdedup.groups(docs), mixing.weights(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
