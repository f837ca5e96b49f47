"""Operators and their registered queries against plain definitions, and against the inputs that broke or cheated them before."""

import base64
import collections
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import bpe_codec, common, embedding_dedup, minhash_dedup, packing, secret_scan, sharding, topk, toxicity


def test_jump_hash_equals_the_scalar_algorithm(spark, tmp_path):
    def scalar(key, shards):
        b, j = -1, 0
        while j < shards:
            b = j
            key = (key * 2862933555777941757 + 1) % 2**64
            j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
        return b

    keys = [random.Random(1).randrange(2**64) for _ in range(3000)] + [0, 2**64 - 1]
    for shards in (1, 2, 40, 41, 1000):
        assert sharding.jump_hash(np.array(keys, np.uint64), shards).tolist() == [scalar(k, shards) for k in keys]
    docs = spark.createDataFrame([(k, f"t{k}") for k in range(200)] + [(None, None)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    hashes = {r.doc_id: r.h % 2**64 for r in docs.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    for r in sharding.op1_jump_sharding(spark, str(tmp_path)).collect():
        assert (r.shard, r.grown_shard) == (scalar(hashes[r.doc_id], 40), scalar(hashes[r.doc_id], 41))
    sharding.write_shards(docs, ["doc_id"], 7, str(tmp_path / "shards"), parts=2)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert {r.doc_id: r["shard"] for r in back.collect()} == {k: scalar(h, 7) for k, h in hashes.items()} and back.count() == 201


@pytest.mark.parametrize("text", [" " * 5_000_000, "\n" * 5_000_000 + "x", "a " + " " * 2_000_000 + "b", "的是" * 800_000, "的，一" * 500_000, "a" * 5_000_000, "Ж" * 60_000 + " я"])
def test_bpe_of_long_runs(text):
    path = bpe_codec.ranks_path()
    enc = bpe_codec.encoding(path)
    ids = bpe_codec.encode(text, path)
    assert enc.decode(ids) == text
    # The library itself, where it can: a run's ids in small, the last blank going with what follows.
    run = len(text) - len(text.lstrip())
    if run > 600_000:
        assert ids == enc._encode_single_piece(text[: run - (run < len(text))]) + enc.encode_ordinary(text[run - (run < len(text)) :])
    elif not text.startswith("a "):
        assert ids == enc.encode_ordinary(text)


def test_bpe_cuts_anywhere_safe(monkeypatch):
    monkeypatch.setattr(bpe_codec, "RUN", 3)
    monkeypatch.setattr(bpe_codec, "LONG_SPACE", bpe_codec.re.compile(f"[{bpe_codec.SPACE}]{{3,}}"))
    path, rng = bpe_codec.ranks_path(), random.Random(1)
    enc = bpe_codec.encoding(path)
    for alphabet in ("ab s'tZ19  \n\t,.!-é中文字я५\u3000 \x1c\u0301😀ßاقİ'll", "a   \n\t 1.,\u3000'"):
        for _ in range(8000):
            text = "".join(rng.choice(alphabet) for _ in range(rng.choice([3, 8, 20, 60])))
            assert bpe_codec.encode(text, path, rng.choice([1, 2, 5])) == enc.encode_ordinary(text), repr(text)


def der(tag, content):
    n = len(content)
    size = bytes([n]) if n < 128 else bytes([0x80 | (n.bit_length() + 7) // 8]) + n.to_bytes((n.bit_length() + 7) // 8, "big")
    return bytes([tag]) + size + content


def sequence(*parts):
    return der(0x30, b"".join(parts))


def test_keys_are_confirmed_by_their_fields(spark):
    rng = random.Random(1)
    integer = lambda n: der(2, bytes([1 + rng.randrange(126)]) + rng.randbytes(n - 1))
    zero, one, oid = der(2, b"\0"), der(2, b"\1"), lambda h: der(6, bytes.fromhex(h))
    rsa = sequence(zero, integer(256), der(2, b"\1\0\1"), integer(256), *(integer(128) for _ in range(5)))
    kind = sequence(oid("2a864886f70d010101"), der(5, b""))
    pkcs8, edwards = sequence(zero, kind, der(4, rsa)), sequence(zero, sequence(oid("2b6570")), der(4, der(4, rng.randbytes(32))))
    sec1 = sequence(one, der(4, rng.randbytes(32)), der(0xA0, oid("2a8648ce3d030107")), der(0xA1, der(3, b"\0\4" + rng.randbytes(64))))
    locked = sequence(sequence(oid("2a864886f70d01050d"), sequence(der(4, rng.randbytes(8)))), der(4, rng.randbytes(64)))
    public = sequence(kind, der(3, b"\0" + sequence(integer(256), der(2, b"\1\0\1"))))
    certificate = sequence(sequence(der(0xA0, der(2, b"\2")), integer(8), kind, sequence(), sequence(), public), kind, der(3, b"\0" + rng.randbytes(256)))
    for key in (rsa, pkcs8, edwards, sec1, locked):
        assert secret_scan.is_key(key) and not secret_scan.is_key(key[:-1]) and not secret_scan.is_key(key + b"\0")
    plain, safe = (lambda d: base64.b64encode(d).decode()), (lambda d: base64.urlsafe_b64encode(d).decode().rstrip("="))
    wrap = lambda s, n, by="\n": by.join(s[i : i + n] for i in range(0, len(s), n))
    forms = [plain(rsa), plain(edwards), plain(sec1), plain(locked), safe(pkcs8), "path/to/" + plain(pkcs8), wrap(plain(pkcs8), 76), wrap(plain(rsa), 64, "\r\n"), wrap(plain(rsa), 64, "\\n"), "0x" + edwards.hex().upper(), rsa.hex(), ":".join(f"{x:02x}" for x in edwards)]
    for form in forms:
        text = f"say {form} and more\nMIIC"
        (start, end, found) = secret_scan.confirmed_spans(text)[0]
        assert found == "der" and text[:start].removesuffix("path/to/").removesuffix("0x") == "say " and text[end:] == " and more\nMIIC", form
    armour = lambda label, body, by="\n": f"-----BEGIN {label}-----{by}{body}{by}-----END {label}-----"
    part = lambda b: len(b).to_bytes(4, "big") + b
    openssh = b"openssh-key-v1\0" + part(b"none") * 2 + part(b"") + (1).to_bytes(4, "big") + part(rng.randbytes(51)) + part(rng.randbytes(136))
    blocks = [armour("RSA PRIVATE KEY", wrap(plain(rsa), 64)), armour("PRIVATE KEY", wrap(plain(pkcs8), 64, "\\n"), "\\n"), armour("OPENSSH PRIVATE KEY", wrap(plain(openssh), 70))]
    blocks.append(armour("RSA PRIVATE KEY", "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,AB\n\n" + wrap(plain(rng.randbytes(256)), 64)))
    for block in blocks:
        assert secret_scan.confirmed_spans("a " + block + " z") == [(2, 2 + len(block), "pem")]
    for clean in (public, certificate, sequence(integer(256), der(2, b"\1\0\1")), openssh[:-1]):
        assert not secret_scan.confirmed_spans(plain(clean)) + secret_scan.confirmed_spans(clean.hex()) + secret_scan.confirmed_spans(armour("PUBLIC KEY", wrap(plain(clean), 64)))
    nested = der(4, b"x" * 8)
    for _ in range(2000):
        nested = der(0x30, nested)
    assert secret_scan.der_closes(nested) and not secret_scan.der_closes(nested[:-1])
    header = base64.urlsafe_b64encode(b'{ "typ": "JWT", "alg": "none"}').decode().rstrip("=")
    for head, found in ((header, True), (base64.urlsafe_b64encode(b'{"typ": "JWT"}').decode().rstrip("="), False), ("eyJ" + "W1tb" * 50_000, False)):
        assert bool(secret_scan.confirmed_spans(f"{head}.e30.c2ln")) == found
    got = secret_scan.secret_spans(spark.createDataFrame([(1, blocks[0]), (2, None), (3, "")], "doc_id long, text string"))
    assert [[tuple(s) for s in r.spans] for r in got.orderBy("doc_id").collect()] == [[("pem", 0, len(blocks[0]))], [], []]


def test_packing_ids_are_the_tokenizers_own():
    from tokenizers import Tokenizer

    tokenizer, memo, rng = Tokenizer.from_file(packing.vocabulary_path()), packing.Chunks(packing.vocabulary_path()), random.Random(2)
    chars = [chr(c) for c in range(0x20, 0x250)]
    for k in range(20_000):
        text = "".join(rng.choice(chars) if rng.random() < 0.5 else rng.choice("abcXYZ '  stll've\n") for _ in range(rng.randint(1, 25)))
        text += rng.choice(["<|endoftext|>", "<|EndOfText|> q", "<|startoftext|><|"]) if k % 50 == 0 else ""
        assert memo.ids(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def plain_kneser_ney(uses, keep):
    """Both classes' probabilities by definition, of (class, before that, context, word) uses with words as strings."""
    stem = lambda w: w[: toxicity.STEM]
    pairs = collections.defaultdict(lambda: [set(), set()])
    for k, u, v, w in uses:
        pairs[v, w][k].add(u)
    count = {p: [len(s) for s in both] for p, both in pairs.items()}
    words = {w for _, w in count}
    stems = {stem(w) for w in words}
    d = lambda counts: toxicity.discount(sum(c == 1 for c in counts), sum(c == 2 for c in counts))
    follows = [{w: sum(c[k] > 0 for (_, x), c in count.items() if x == w) for w in words} for k in (0, 1)]
    forms = [{s: sum(follows[k][w] > 0 for w in words if stem(w) == s) for s in stems} for k in (0, 1)]
    low = {s: (forms[0][s] > 0) + (forms[1][s] > 0) for s in stems}
    dl, total = d(low.values()), sum(low.values())
    out = []
    for k in (0, 1):
        even = dl * len(stems) / (len(stems) + 1) / total
        mix = lambda c, size, disc, kinds, below: max(c - disc, 0) / size + disc * kinds / size * below
        ds, ns, ts = d(forms[k].values()), sum(forms[k].values()), sum(c > 0 for c in forms[k].values())
        stem_p = {s: mix(forms[k][s], ns, ds, ts, (low[s] - dl) / total + even) for s in stems}
        size = {s: 1 + sum(stem(w) == s for w in words) for s in stems}
        dw, nw, tw = d(follows[k].values()), sum(follows[k].values()), sum(c > 0 for c in follows[k].values())
        word = {w: mix(follows[k][w], nw, dw, tw, stem_p[stem(w)] / size[stem(w)]) for w in words}
        other = {s: dw * tw / nw * stem_p[s] / size[s] for s in stems} | {None: dw * tw / nw * ds * ts / ns * even}
        dp = d([c[k] for c in count.values()])

        def after(v, w, k=k, dp=dp, word=word):
            own = {x: c[k] for (y, x), c in count.items() if y == v and c[k]}
            if not own:
                return word[w]
            kept = {x: n - dp for x, n in own.items() if sum(count[v, x]) >= keep}
            return kept.get(w, 0) / sum(own.values()) + (1 - sum(kept.values()) / sum(own.values())) * word[w]

        out.append((word, other, after))
    return out


def test_kneser_ney_equals_the_definition(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "KEEP", 2)
    rng = random.Random(3)
    vocabulary = [f"{a}{b}" for a in ("toma", "kile", "se", "vequ", "noma") for b in ("", "ru", "ti")]
    texts = [(k % 2, " ".join(rng.choice(vocabulary[: 9 + 6 * (k % 2)]) for _ in range(rng.randrange(1, 14)))) for k in range(60)]
    texts += [texts[0]] * 5 + [(0, ""), (1, None)]
    counts = toxicity.counted(spark.createDataFrame(texts, "toxic int, text string"))
    uses = {(k, *x) for k, t in texts for w in [["", "", *(t or "").split()]] for x in zip(w, w[1:], w[2:], strict=False)}
    plain = plain_kneser_ney(uses, 2)
    place = {w: toxicity.place_of(counts.words, toxicity.START if w == "" else toxicity.hash_of(w)) for w in ["", *vocabulary]}
    for k, (word, other, after) in enumerate(plain):
        own = toxicity.KneserNey(counts, k)
        for w, p in word.items():
            assert math.isclose(own.word[place[w]], p, rel_tol=1e-9)
        for s, p in other.items():
            assert math.isclose(own.other[toxicity.place_of(counts.stems, toxicity.hash_of(s)) if s else -1], p, rel_tol=1e-9)
        assert math.isclose(own.word.sum() + own.other.sum(), 1, abs_tol=1e-9)
        for v in ["", *word]:
            if place[v] == len(counts.words):
                continue
            pairs = {int(w): own.pair[i] for i, (a, w) in enumerate(zip(counts.first, counts.second, strict=True)) if a == place[v]}
            each = {w: pairs.get(place[w], own.left[place[v]] * own.word[place[w]]) for w in word}
            assert all(math.isclose(each[w], after(v, w), rel_tol=1e-9) for w in word)
            assert math.isclose(sum(each.values()) + own.left[place[v]] * own.other.sum(), 1, abs_tol=1e-9)
    model = toxicity.model_of(counts)
    lookup = toxicity.Lookup(model)
    text = ["vequru", "tomati", "vequnew", "zzzz", "se"]
    each = []
    for v, w in zip(["", *text], text, strict=False):
        (p0, o0, a0), (p1, o1, a1) = plain
        unseen = [o0.get(w[:4], o0[None]), o1.get(w[:4], o1[None])]
        left = [1.0 if v not in place or place[v] == len(counts.words) else toxicity.KneserNey(counts, k).left[place[v]] for k in (0, 1)]
        each.append(math.log(a1(v, w) / a0(v, w)) if w in p0 else math.log(unseen[1] * left[1] / unseen[0] / left[0]))
    assert np.allclose(toxicity.evidence(" ".join(text), lookup, model), [np.mean(each), max(each)], atol=1e-5)


def test_toxicity_query_and_sample_bounds(spark, tmp_path):
    rng = random.Random(1)
    plain = [f"{a}{b}" for a in ("mora", "tesi", "lunu", "kafe") for b in range(60)]
    rows, labels = [], []
    for k in range(500):
        words = [rng.choice(plain) for _ in range(30)]
        if k % 5 == 1:
            words[rng.randrange(30)] = rng.choice(["idiotic", "scumbag"])
        rows.append((k, " ".join(words)))
        labels.append((k, 1, int(k % 5 == 1)))
    rows += [(None, "idiotic"), (600, None), (601, ""), (602, rows[1][1]), (602, rows[1][1])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    marks = spark.createDataFrame([*labels, (None, 1, 1), (600, 1, None)], "doc_id long, quality int, toxic int")
    marks.write.parquet(str(tmp_path / "labels.parquet"))
    got = toxicity.op6_toxicity(spark, str(tmp_path)).collect()
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(k for k, _ in rows)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    held = [r for r in got if r.held_out and r.doc_id < 500]
    assert np.mean([r.predicted == labels[r.doc_id][2] for r in held]) > 0.97
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    sample, labelled = toxicity.sampled(docs, marks, rows=20, size=2000)
    sizes = {k: sum(len(rows[i][1]) for i, x in sample if x == k) for k in (0, 1)}
    assert labelled == [400, 100] and 0 < max(sizes.values()) <= 2000 and max(collections.Counter(k for _, k in sample).values()) <= 20


def test_threshold_ends_walks(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(64, 64))
    v = centres[rng.integers(0, 64, 4000)] + 0.3 * rng.normal(size=(4000, 64))
    v /= np.linalg.norm(v, axis=1)[:, None]
    block = topk.Block(list(range(4000)), v.tolist())
    steps, ended, seen = np.floor(v * 64), 0, 0
    for q in range(0, 4000, 100):
        found, n = block.best(q, v[q].tolist())
        scores = (steps @ steps[q]).astype(int)
        order = [i for i in np.lexsort((np.arange(4000), -scores)) if i != q][:20]
        assert found == [(i, scores[i]) for i in order]
        ended, seen = ended + (n < 4000), seen + n
    assert ended == 40 and seen < 0.4 * 40 * 4000
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<double>")
    report = topk.walk_report(df, F.col("id") % 200 == 0).first()
    assert report.walks == 20 and report.ended == 20 and 0 < report.seen < 0.4


def test_top_k_of_large_components_and_repeated_rows(spark):
    rows = [(0, [1e9, 0.0, 0.0, 0.0]), (20, [1.0, 2.0, 3.0, 4.0]), (3, [-1e300, 1e300, 5.0, 1e-3]), (4, [2.0**53, 1.0, 1.0, 1.0]), (5, [0.5, -0.5, 0.0, -0.0])]
    rows += [(40, [0.25, 0.5, 0.75, 0.125])] * 2 + [(60, [1.0, 0.0, 0.0, 0.0]), (60, [0.0, 1.0, 0.0, 0.0])] + [(k, [k / 64, 0.5, -0.25, 0.0]) for k in range(61, 75)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 20 == 0, k=4).collect()
    whole = lambda v: [math.floor(64 * x) if abs(x) < 2.0**40 else int(x) * 64 for x in v]
    want = collections.Counter()
    for q, v in {(q, tuple(v)) for q, v in rows if q % 20 == 0}:
        found = sorted((-min(topk.MOST, max(topk.LEAST, sum(a * b for a, b in zip(whole(v), whole(w), strict=True)))), i) for i, w in rows if i != q)[:4]
        want.update((q, n, i, -s) for n, (s, i) in enumerate(found, 1))
    assert collections.Counter((r.query_id, r["rank"], r.id, r.score) for r in got) == want


def test_insertion_graph_finds_planted_clusters(spark, tmp_path):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(500, 64))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    v = centres[rng.integers(0, 500, 6096)] + 0.012 * rng.normal(size=(6096, 64))
    v /= np.linalg.norm(v, axis=1)[:, None]
    graph = embedding_dedup.Graph(v[:4096].copy())
    beam, recall, audited = graph.beam(v[4096:5096])
    assert 0 < beam < 1024 and recall >= 0.99 and audited > 100
    for queries, own in ((v[4096:], False), (v[:4096], True)):
        truth = queries @ graph.vectors.T >= embedding_dedup.COSINE
        if own:
            np.fill_diagonal(truth, False)
        hits = sum(int(t[f].sum()) for t, f in zip(truth, graph.search(queries, beam), strict=True))
        assert hits >= 0.99 * truth.sum() > 10_000
    rows = [(k, x.tolist(), 0) for k, x in enumerate(v[:600])] + [(700, v[0].tolist(), 0), (701, None, 0), (702, v[0].tolist(), None), (None, v[1].tolist(), 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {r.vec_id: r for r in embedding_dedup.op9_hnsw_dedup(spark, str(tmp_path)).collect()}
    every = np.concatenate([v[:600], v[:1], v[1:2]])
    near = every @ every.T >= embedding_dedup.COSINE
    assert [got[k].n_links for k in range(600)] == (near[:600].sum(1) - 1).tolist() and len(got) == len(rows)
    assert got[700].component_id == got[0].component_id and got[701].n_links == 0 and got[702].component_id == 702 and not got[700].kept
    df = spark.read.parquet(str(tmp_path / "embeddings.parquet"))
    assert [r.recall >= 0.99 and r.vectors == 600 for r in embedding_dedup.recalls(df).collect()] == [True]


def test_near_duplicate_query_keeps_one_of_each(spark, tmp_path):
    words = [f"w{k}" for k in range(40)]
    rows = [(5, " ".join(words)), (5, " ".join(words)), (5, " ".join([*words, "tail"])), (9, " ".join([*words, "end"])), (None, " ".join(words)), (7, None), (7, None), (8, ""), (6, "something else entirely here now")]
    spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, component string").write.parquet(str(tmp_path / "documents.parquet"))
    got = minhash_dedup.op10_bag_minhash(spark, str(tmp_path)).collect()
    assert collections.Counter((r.doc_id, r.component_id) for r in got) == collections.Counter({(5, 5): 3, (9, 5): 1, (None, 5): 1, (7, 7): 2, (8, 8): 1, (6, 6): 1})
    assert sum(r.kept for r in got if r.component_id == 5) == 1 and all(r.kept for r in got if r.component_id != 5)


def test_signature_filter_misses_no_pair_at_the_threshold():
    """LIKELY against the agreement of pairs whose similarity is just over the threshold."""
    rng = np.random.default_rng(2)
    least = 1.0
    for _ in range(400):
        keys = rng.integers(1, 2**63, 110).astype(np.uint64)
        a, b = np.sort(keys[:100]), np.sort(keys[10:111])
        bags = [(a, np.ones(len(a), np.int64)), (b, np.ones(len(b), np.int64))]
        assert minhash_dedup.similarity(*bags) >= minhash_dedup.SIMILARITY
        marks = minhash_dedup.signatures(bags) & np.uint64(255)
        least = min(least, float((marks[0] == marks[1]).mean()))
    assert least >= minhash_dedup.LIKELY


@pytest.mark.parametrize("kind", ["long", "binary"])
def test_hot_keys_join_like_all_others(spark, kind, monkeypatch):
    monkeypatch.setattr(common, "HOT", 5)
    key = F.col("k") if kind == "long" else F.encode(F.col("k").cast("string"), "UTF-8")
    rows = [(k, v) for k, n in ((1, 60), (2, 30), (3, 5), (4, 1), (None, 4)) for v in range(n)]
    left = spark.createDataFrame(rows, "k long, v long").withColumn("k", key)
    right = spark.createDataFrame([(1, 60, "a"), (2, 30, "b"), (3, 5, None), (9, 1, "z")], "k long, weight long, x string").withColumn("k", key)
    for how in ("inner", "left"):
        got = common.hot_join(left, right, "k", "weight", len(rows), how)
        want = left.join(right.drop("weight"), "k", how)
        text = lambda df: collections.Counter((str(r.k), r.v, r.x) for r in df.collect())
        assert text(got) == text(want)


def test_dedup_queries_equal_their_sql(spark, tmp_path):
    import duckdb

    rng = random.Random(3)
    vocabulary = [f"Wort{k}" for k in range(60)]
    texts = [None, None, "", "   ", "one two", "One TWO", "a b a b a b a b a b a b a b a b", "a b a b a b a b a b a b a b"]
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([4, 6, 60]))]
        texts += [" ".join(base), "\t".join([*base, "tail"]), " ".join(base[:-3] + ["x"] * rng.choice([0, 2, 30])).lower()]
    rows = [(k if k % 9 else None, t, "x") for k, t in enumerate(texts)] + [(1, texts[20], "y"), (1, texts[20], "z"), (2, "again", "x")]
    spark.createDataFrame(rows, "doc_id long, text string, component_id string").write.parquet(str(tmp_path / "documents.parquet"))
    dim = 6
    points = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(30)]
    vectors = [(k, [x + rng.gauss(0, 0.12) for x in points[k % 30]], k % 2) for k in range(300)]
    vectors += [(1, vectors[0][1], 0), (1, vectors[0][1], 0), (400, None, 0), (401, [0.0] * dim, 0), (402, [None, *[1.0] * 5], 0), (403, [math.inf, *[1.0] * 5], 0), (404, [math.nan, *[1.0] * 5], 0), (405, [], 0)]
    vectors += [(406, points[0], None), (407, [2 * x for x in vectors[2][1]], 0), (None, vectors[2][1], 0), (408, vectors[2][1][:5], 0), (None, None, None)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<double>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    for name in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    for query, sql in ((minhash_dedup.op10_bag_minhash, minhash_dedup.OP10_SQL), (embedding_dedup.op9_hnsw_dedup, embedding_dedup.OP9_SQL)):
        found = con.execute(sql)
        names = [c[0] for c in found.description]
        want = collections.Counter(found.fetchall())
        got = collections.Counter(tuple(r) for r in query(spark, str(tmp_path)).select(*names).collect())
        assert got == want, (query.__name__, sorted((got - want).items(), key=str)[:5], sorted((want - got).items(), key=str)[:5])
    assert sum(n for _, n in want.items()) == len(vectors) and any(r[names.index("n_links")] > 3 for r in want)
