"""Token files, whitening and the manifest: against brute force, round trips, and their edge cases."""

import hashlib
import zlib
from itertools import groupby

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quern.llm import manifest, tokens, whitening
from tests.compare import SMALL

NAMES = "doc_id long, source string, lang string, n_chars long, text string, digest int, tree int, at int"


def library():
    own = Tokenizer.from_file(public_tokenizers.path(tokens.VOCABULARY))
    own.encode_special_tokens = True
    return own


def documents(spark, folder=SMALL):
    return spark.read.parquet(f"{folder}/documents.parquet").toPandas().astype(object).where(lambda x: x.notna(), None).to_dict("records")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 300), max_size=400), min_size=1, max_size=6))
def test_coder_round_trip(docs):
    rows = [(k if k % 3 else None, np.array(x, np.uint32)) for k, x in enumerate(docs)]
    coder = tokens.Coder(tokens.normalized(np.bincount(sum(docs, []) or [0], minlength=5)))
    doc_ids, nulls, lengths, ids, _ = tokens.unpacked(coder, tokens.packed(coder, rows))
    assert [None if n else int(d) for d, n in zip(doc_ids, nulls)] == [d for d, _ in rows]
    assert lengths.tolist() == list(map(len, docs)) and ids.tolist() == sum(docs, [])


def test_coder_starts_at_any_checkpoint_and_finds_damage():
    rng = np.random.default_rng(3)
    ids = np.minimum(rng.zipf(1.3, 2_000_000), 49_000).astype(np.uint32)
    coder = tokens.Coder(tokens.normalized(np.bincount(ids)))
    data = tokens.packed(coder, [(1, ids)])
    entropy = -sum(p * np.log2(p) for p in np.bincount(ids)[np.bincount(ids) > 0] / len(ids)) * len(ids) / 8
    assert len(data) < 1.05 * entropy
    for first, last in ((0, 1), (1, 3), (3, None), (7, 8), (99, None)):
        *_, part, at = tokens.unpacked(coder, data, first, last)
        assert np.array_equal(part, ids[at : at + len(part)]) and (len(part) > 0) == (first < 8)
    for k in (10, len(data) // 2, len(data) - 1):
        with pytest.raises(ValueError):
            tokens.unpacked(coder, data[:k] + bytes([data[k] ^ 1]) + data[k + 1 :])
    with pytest.raises(ValueError):
        coder.encode(np.array([49_001], np.uint32))


@pytest.mark.parametrize("counts", [[], [0, 0], [5], [1] * 1000 + [10**12], [10**15, 1, 0, 1], list(range(3000))])
def test_frequencies_add_up(counts):
    got = tokens.normalized(np.array(counts, np.int64))
    assert got.sum() == (1 << tokens.SCALE if sum(counts) else 0) and all((g > 0) == (c > 0) for g, c in zip(got, counts))


def expected_ids(rows):
    """doc_id, start, n_tokens, crc, ids of rows (doc_id, text), whole texts by the library; rows of one id in the order given."""
    start, out, own = 0, [], library()
    for doc_id, text in rows:
        ids = own.encode(text or "", add_special_tokens=False).ids + [tokens.END]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    return out


def test_op11_equals_the_library(spark):
    want = expected_ids(sorted((r["doc_id"], r["text"]) for r in documents(spark)))
    got = sorted(map(tuple, tokens.op11_token_files(spark, SMALL).collect()))
    assert got == [x[:4] for x in want]


TEXTS = ["", None, "a b", "Ünï  CÖDÉ é x y", "tab\tnew\nline\x0bv\x0cf\rr \x1c\x85 z", "<|endoftext|> x<|startoftext|>y", "日本語のテキスト 한국어 ไทย", "ΣΑΣ ΟΔΟΣ. İI", "́ ́a 가 ᄀ ᅡ",
         "don't WE'LL 'S's 123,456 $%&*()", "#" * 300, "x" * 5000, "😀👍🏽 \x00 ﻿", "word " * 40_000, " ", "\n\n"]


def test_op11_edges(spark, tmp_path):
    """Texts of all kinds, null and repeated ids, extra columns, an empty table; blocks of a few ids in several files; files that stand alone."""
    rows = [(k, t, "x", 1) for k, t in enumerate(TEXTS)] + [(None, "null id", "x", 1), (None, "a b", "x", 1), (-5, "less", "x", 1), (3, TEXTS[3], "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, start int").repartition(3)
    folder = str(tmp_path / "own")
    index = tokens.write_ids(df, folder, file_ids=150, block_ids=50)
    got = tokens.read_ids(index, folder).orderBy("start").collect()
    ordered = sorted(((d is not None, d or 0), i, d, t) for i, (d, t, *_) in enumerate(rows))
    want = expected_ids([(d, t) for *_, d, t in ordered])
    by_id = lambda x: sorted((str(r[0]), list(r[4])) for r in x)
    assert by_id(got) == by_id(want)
    assert [r.doc_id for r in got] == [r[0] for r in want]
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.n_tokens == len(r.ids) for r in got)
    assert index.count() > 3
    for r in index.groupBy("file").agg(F.count("*").alias("n"), F.sum("ids").alias("ids")).collect():
        blocks = tokens.file_blocks((tmp_path / "own" / r.file).read_bytes())
        assert len(blocks) == r.n and sum(b[2] for b in blocks) == r.ids
    assert tokens.read_ids(tokens.write_ids(df.limit(0), folder + "2"), folder + "2").count() == 0
    # As special tokens, if asked; and a damaged file isn't read.
    special = tokens.write_ids(df.where("doc_id = 5"), folder + "3", special=True)
    assert 49407 in tokens.read_ids(special, folder + "3").first().ids
    at = tmp_path / "own3" / special.first().file
    at.write_bytes(at.read_bytes().replace(b"QIDS", b"QXDS", 1))
    with pytest.raises(Exception, match="checksum|frequencies"):
        tokens.read_ids(special, folder + "3").collect()


def whitened(vectors, k):
    """Rows (place, component, n, deviation, whitened, explained) by numpy over all vectors of one length."""
    x = [[int(np.floor(256 * float(c))) for c in v] for v in vectors]
    fit = np.array([list(v) for v in dict.fromkeys(map(tuple, x))], object)
    n, s = len(fit), fit.sum(axis=0)
    centred = fit.astype(float) - np.array([float(v) / n for v in s])
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1], u.T[::-1]
    for place, v in enumerate(x):
        for c in range(min(k, len(e))):
            w = (np.array(v, float) - np.array([float(a) / n for a in s])) @ u[c] / np.sqrt(e[c])
            yield place, c + 1, n, sum((n * a - b) ** 2 for a, b in zip(v, s)), w, e[c] / e.sum()


def assert_whitened(got, vectors, ids, k):
    want = list(whitened(vectors, k))
    assert len(got) == len(want)
    rows = {(r[0], r[1]): r for r in got}
    signs = {}
    for place, c, n, deviation, w, share in want:
        r = rows[ids[place], c]
        sign = signs.setdefault(c, np.sign(r.whitened * w)) if abs(w) > 1e-6 else signs.get(c, 1)
        assert (r.n, r.deviation) == (n, deviation) and r.whitened == pytest.approx(sign * w, abs=1e-8)
        assert r.explained == pytest.approx(share, rel=1e-9) and 0 <= r.identity_error < 1e-9


def test_op12_equals_numpy(spark):
    t = pq.read_table(f"{SMALL}/embeddings.parquet")
    got = whitening.op12_whitening(spark, SMALL).collect()
    assert_whitened(got, t.column("embedding").to_pylist(), t.column("vec_id").to_pylist(), 4)


def test_op12_edges(spark):
    """Vectors left out, repeated ones, another length, constant entries, one vector alone, great numbers, an empty table."""
    rng = np.random.default_rng(5)
    sound = rng.normal(size=(40, 5)).tolist()
    bad = [None, [1.0, None, 2.0, 3.0, 4.0], [float("nan")] * 5, [float("inf")] * 5, [1e300] * 5]
    rows = [(k, v, "x") for k, v in enumerate(sound + sound[:7] + bad)]
    schema = "vec_id long, embedding array<double>, component string"
    df = spark.createDataFrame(rows, schema).repartition(5)
    got = whitening.whiten(df, 4).collect()
    assert_whitened(got, sound + sound[:7], range(47), 4) if (got := sorted(got, key=lambda r: (r.vec_id, r.component))) else pytest.fail()
    lengths = spark.createDataFrame([(100 + k, v[:2], "x") for k, v in enumerate(sound)] + [(200, [], "x"), (201, [7.0], "x"), (None, [7.0], "x")], schema)
    both = whitening.whiten(df.union(lengths), 4).collect()
    assert_whitened([r for r in both if r.vec_id is not None and 100 <= r.vec_id < 200], [v[:2] for v in sound], range(100, 140), 4)
    alone = [r for r in both if r.vec_id in (201, None)]
    assert [(r.n, r.deviation, r.whitened, r.explained) for r in alone] == [(1, 0, None, None)] * 2
    flat = whitening.whiten(spark.createDataFrame([(k, [float(k), 1.0], "x") for k in range(9)], schema), 2).collect()
    assert all((r.whitened is None) == (r.component == 2) and r.identity_error < 1e-12 for r in flat)
    assert whitening.whiten(df.limit(0), 4).count() == 0
    big = whitening.whiten(spark.createDataFrame([(k, [k * 1e5, -k * 1e5], "x") for k in range(9)], schema), 1).collect()
    assert sum(r.deviation for r in big if r.vec_id == 8) == 2 * (9 * 8 * 25_600_000 - 36 * 25_600_000) ** 2
    with pytest.raises(Exception, match="64 bits"):
        whitening.whiten(spark.createDataFrame([(k, [k * 1e9], "x") for k in range(9)], schema), 1).collect()


def test_moments_merge_like_the_whole():
    rng = np.random.default_rng(7)
    x = rng.integers(-300, 300, (500, 6)) + 10**7
    whole, parts = whitening.moments(x), [whitening.moments(p) for p in np.array_split(x, [3, 4, 200])]
    got = whitening.merged(whitening.merged(parts[0], parts[1]), whitening.merged(parts[2], parts[3]))
    assert got.n == 500 and got.sums == whole.sums == x.sum(axis=0).tolist()
    assert np.allclose(got.scatter, np.cov(x.T.astype(float), bias=True) * 500, rtol=1e-9)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(r):
    values = [r[f] for f in manifest.FIELDS]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def trees(rows):
    """Rows (key, leaf, subroot, root, proof, folded, verified) by plain loops."""

    def climb(nodes):
        """The root, and for each leaf its list of (left, right) by level."""
        paths, owners = [[] for _ in nodes], [[k] for k in range(len(nodes))]
        while len(nodes) > 1:
            runs = [range(k, min(k + 3, len(nodes))) for k in range(0, len(nodes), 3)]
            for run in runs:
                for k in run:
                    for leaf in owners[k]:
                        paths[leaf].append(("".join(nodes[j] for j in run if j < k), "".join(nodes[j] for j in run if j > k)))
            owners = [[x for k in run for x in owners[k]] for run in runs]
            nodes = [sha("".join(nodes[j] for j in run)) for run in runs]
        return nodes[0], paths

    def changed(r):
        even = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0
        return leaf_of(r | {"text": r["text"].replace("\n", "") if even and r["text"] is not None else r["text"]})

    name = lambda r: (r["source"] is not None, (r["source"] or "").encode())
    key = lambda r: (name(r), r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r))
    groups = [list(g) for _, g in groupby(sorted(rows, key=key), key=name)]
    own = [climb([leaf_of(r) for r in g]) for g in groups]
    root, above = climb([x[0] for x in own]) if own else ("", [])
    for g, (subroot, paths), up in zip(groups, own, above):
        for r, path in zip(g, paths):
            h = changed(r)
            for left, right in path + up:
                h = sha(left + h + right)
            yield r["doc_id"], leaf_of(r), subroot, root, sha("".join(a + b for a, b in path + up)), h, h == root


def test_op13_equals_loops(spark):
    got = manifest.op13_merkle_manifest(spark, SMALL).collect()
    assert sorted(map(tuple, got)) == sorted(trees(documents(spark)))
    assert {r.verified for r in got} == {True, False}


def test_op13_edges(spark, tmp_path):
    """Null keys, groups and fields, repeated rows, groups of 1 to 82 rows, line feeds, an extra column; one group; one row; none."""
    sizes = {None: 4, "": 1, "b": 3, "a": 82, "é": 9, "z": 10, "Z": 27, "\U0001f600": 2}
    rows = [(k * 7 % 100, s, "en" if k % 2 else None, k, f"text {k}\nline" if k % 5 else None) for s, n in sizes.items() for k in range(n)]
    rows += [(None, "a", None, None, None), (None, "a", "x", 1, "t\n"), rows[5], rows[5], (10**12, None, "", -3, "")]
    frame = lambda x: spark.createDataFrame([(*r, 1, 2, 3) for r in x], NAMES).repartition(5)
    for part in (rows, rows[:4], rows[4:5], [(k, "g", "l", k, "t") for k in range(28)], []):
        frame(part).write.parquet(f"{tmp_path}/{len(part)}/documents.parquet")
        got = manifest.op13_merkle_manifest(spark, f"{tmp_path}/{len(part)}").collect()
        names = ("doc_id", "source", "lang", "n_chars", "text")
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, trees([dict(zip(names, r)) for r in part])))
