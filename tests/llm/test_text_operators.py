"""Tokenising, packing, substring and line removal, SimHash: against brute force and on odd rows."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from ludoscope.llm import bpe, lines, packing, simhash, substrings

ODD = ["", None, " ", "a", "\n\n", "日本語 テキスト", "x\x00y \x1c z", "don't  CAN'T 12 ４", "a b c " * 9000, "word", "word", "Ünï H̱ Σ <|endoftext|>    é"]


def odd(spark, texts=None):
    """Odd texts, repeated rows, a null id, and columns named like the operators' own."""
    rows = [(i, t) for i, t in enumerate(ODD if texts is None else texts)]
    rows += [rows[-1], (None, "null id"), (None, "null id"), (3, "same id, other text")] if texts is None else []
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({c: F.lit(None).cast("string") for c in ("doc", "key", "h", "t", "rep", "line", "start", "component_id", "fingerprint", "n", "length", "piece", "id", "first")})


def small(spark, n=120):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where(F.col("doc_id") < n)


def components(ids, linked):
    label = {i: i for i in ids}
    todo = True
    while todo:
        todo = False
        for a, b in linked:
            m = min(label[a], label[b])
            if label[a] != m or label[b] != m:
                label[a] = label[b] = m
                todo = True
    return label


# -- operator 10 --------------------------------------------------------------------


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encoder_is_tiktokens(tiktoken_encoding, monkeypatch):
    e = bpe.Encoder(bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), P.PATTERN)
    r = random.Random(1)
    texts = [t for t in ODD if t] + ["".join(r.choice(" \n\tab1.'\x1c \x85é") for _ in range(r.randint(0, 14))) for _ in range(2000)]
    for run in (1_000_000, 3):
        monkeypatch.setattr(bpe, "RUN", run)
        for t in texts:
            ids = e.encode(t)
            assert ids == tiktoken_encoding.encode_ordinary(t)
            assert e.decode(ids) == t.encode()
    monkeypatch.setattr(bpe, "CACHE", 2)
    assert e.encode_batch(["one two three", "two one"]) == [tiktoken_encoding.encode_ordinary(x) for x in ("one two three", "two one")]


def test_codec_rows(spark, tiktoken_encoding):
    df = odd(spark)
    got = bpe.encode_digests(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    told = Counter()
    for r in df.collect():
        ids = tiktoken_encoding.encode_ordinary(r.text or "")
        told[(r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())] += 1
    assert Counter(map(tuple, got.collect())) == told
    whole = bpe.encode(small(spark, 5), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).join(small(spark, 5), "doc_id")
    assert whole.where("decoded = cast(text as binary) and n_tokens = size(ids)").count() == 5
    assert bpe.encode(df.limit(0), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


# -- operator 9 ------------------------------------------------------------------------


def placed(counts, capacity, **how):
    rows, n = packing.plan(counts, capacity, **how)
    seen, use = Counter(), defaultdict(list)
    for s, _, m, first, offset, each in rows.tolist():
        seen[s] += m
        for j in range(m):
            use[first + j // each].append((offset + j % each * s, s))
    assert dict(seen) == {s: m for s, m in counts.items() if m}
    for own in use.values():
        at = 0
        for offset, s in sorted(own):
            assert offset == at
            at += s
        assert at <= capacity
    assert sorted(use) == list(range(n))
    return n


def test_plan():
    assert placed({}, 10) == 0
    assert placed({10: 3, 5: 1}, 10) == 4
    assert placed({6: 5, 4: 5}, 10) == 5
    r = random.Random(2)
    for _ in range(150):
        cap = r.choice([5, 10, 16, 50])
        counts = {r.randint(1, cap): r.randint(1, 40) for _ in range(r.randint(0, 12))}
        n = placed(counts, cap, groups=r.choice([1, 3, 8]))
        assert n >= -(-sum(s * m for s, m in counts.items()) // cap)
    near = {r.randint(1, 2048): r.randint(1, 9) for _ in range(900)}
    assert placed(near, 2048) <= placed(near, 2048, large=(1.0,))  # best-fit of all lengths alone
    with pytest.raises(ValueError):
        packing.plan({11: 1}, 10)


def test_packing_rows(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    df = odd(spark).unionByName(small(spark, 30), allowMissingColumns=True)
    got = packing.pack_documents(df, P.path("word_bpe_49k.json"), capacity=64).collect()
    told = Counter()
    for r in df.collect():
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 0]
        for k, a in enumerate(range(0, len(ids), 64)):
            own = ids[a : a + 64]
            told[(r.doc_id, k, a, len(own), zlib.crc32(np.array(own, dtype="<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == told
    use = defaultdict(list)
    for r in got:
        use[r.sequence_id].append((r.offset, r.length))
    for own in use.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack_documents(df.limit(0), P.path("word_bpe_49k.json")).count() == 0


def test_long_text_in_runs(monkeypatch):
    c = packing.Chunks(open(P.path("word_bpe_49k.json")).read())
    text = "Some words, and more: don't stop 123. " * 50
    whole = c.ids([text])[0]
    monkeypatch.setattr(packing, "RUN", 40)
    assert c.long_ids(text) == whole


# -- operator 5 ---------------------------------------------------------------------------


def removed_by_hand(rows, length):
    """Rows (id, text) with distinct ids, in order of ids."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        w = (text or "").encode().split()
        gone = [False] * len(w)
        for s in range(len(w) - length + 1):
            k = tuple(w[s : s + length])
            if k in seen:
                gone[s : s + length] = [True] * length
            seen.add(k)
        out[i] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("length", [4, 5, 20])
def test_substrings(spark, length):
    r = random.Random(length)
    made = [(1000 + i, " ".join(r.choice("abc") for _ in range(r.randint(0, 40)))) for i in range(30)]
    rows = [(x.doc_id, x.text) for x in small(spark).collect()] + made + [(2000, None), (2001, ""), (2002, made[3][1]), (2003, made[3][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit(1))
    got = {x.doc_id: (x.n_words, x.n_removed, x.kept_sha256) for x in substrings.remove_repeats_digest(df, length).collect()}
    assert got == removed_by_hand(rows, length)


def test_substring_levels(spark):
    words = [f"w{i}" for i in range(100)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, "x " + " ".join(words[:90])), (3, " ".join(words[50:56]))], "doc_id long, text string")
    got = {n: w.select("doc", "start").collect() for n, w in substrings.levels(df, 10)}
    assert set(got) == {10, 20, 40, 80}
    assert sorted(map(tuple, got[80])) == sorted([(1, i) for i in range(11)] + [(2, i + 1) for i in range(11)])


def test_substring_odd_rows(spark):
    got = substrings.remove_repeats(odd(spark), 20, keep=("h", "key"))
    assert got.count() == len(ODD) + 4 and got.columns == ["doc_id", "n_words", "n_removed", "kept", "h", "key"]
    by = {(r.doc_id, r.n_words): r for r in got.collect()}
    # a b c a b c ...: the first three windows are new, so the first 22 words stay
    assert by[(8, 27000)].n_removed == 27000 - 3
    assert got.where("n_removed = 0 and n_words < 20").count() == len(ODD) + 3
    assert substrings.remove_repeats(odd(spark).limit(0), 20).count() == 0
    long, other = " ".join(f"w{i}" for i in range(30)), " ".join(f"v{i}" for i in range(30))
    shared = spark.createDataFrame([(1, long), (5, long), (5, other), (5, other), (None, long), (None, other), (9, long)], "doc_id long, text string")
    got = {(r.doc_id, r.kept[:2], r.n_removed) for r in substrings.remove_repeats(shared, 20).collect()}
    assert got == {(1, "w0", 0), (5, "", 30), (5, "v0", 0), (None, "", 30), (9, "", 30)}


# -- operator 4 ---------------------------------------------------------------------------------


def lines_by_hand(rows):
    """Kept texts; lines link if they share a block of bits and their edit distance is at
    most a fifth of the longer one."""
    first = {}
    for i, text in sorted(rows):
        for k, line in enumerate((text or "").split("\n")):
            if x := lines.normalised(line):
                first.setdefault(x, (i, k))
    all_lines = list(first)
    blocks = [set(x) for x in zip(*(b.tolist() for b in lines.blocks(lines.simhashes(lines.normal_lines(["\n".join(all_lines)])))), strict=True)]
    fuzzy = [" " in x and len(x) >= 5 for x in all_lines]
    links = []
    for a in range(len(all_lines)):
        for b in range(a):
            if fuzzy[a] and fuzzy[b] and blocks[a] & blocks[b]:
                most = max(len(all_lines[a]), len(all_lines[b])) // 5
                if lines.edit_distance(all_lines[a], all_lines[b], most) <= most:
                    links.append((a, b))
    group = components(range(len(all_lines)), links)
    keeper = {}
    for x, at in first.items():
        g = group[all_lines.index(x)]
        keeper[g] = min(keeper.get(g, at), at)
    where = {x: k for k, x in enumerate(all_lines)}
    out = {}
    for i, text in rows:
        stay = []
        for k, line in enumerate((text or "").split("\n")):
            x = lines.normalised(line)
            if not x or keeper[group[where[x]]] == (i, k):
                stay.append(line)
        out[i] = "\n".join(stay)
    return out, len(links)


@pytest.mark.parametrize("few", [32, 2])
def test_lines(spark, few):
    r = random.Random(3)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "tu") for b in ("ra", "sen", "tol", "vu", "xi")]
    base = [" ".join(r.choice(words) for _ in range(25)) for _ in range(6)]
    rows = [(x.doc_id, x.text) for x in small(spark, 40).collect()]
    for i in range(60):
        own = []
        for _ in range(r.randint(1, 4)):
            w = r.choice(base).split()
            for _ in range(r.randint(0, 2)):
                w[r.randrange(len(w))] = r.choice(words)
            own.append(" ".join(w))
        rows.append((500 + i, "\n".join(own + ["-- !", "Page 12", "page 99."][: r.randint(0, 3)])))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("line", F.lit(1))
    got = {x.doc_id: x.text for x in lines.dedup(df, few=few).collect()}
    told, links = lines_by_hand(rows)
    assert links > 100
    assert got == told


def test_line_odd_rows(spark):
    got = lines.dedup(odd(spark), keep=("h", "line"))
    assert got.count() == len(ODD) + 4 and got.columns == ["doc_id", "h", "line", "n_lines", "n_removed", "text"]
    by = {r.doc_id: r for r in got.collect()}
    assert by[4].text == "\n\n" and by[1].text == "" and by[9].text == "word" and by[10].text == ""
    assert lines.dedup(odd(spark).limit(0)).count() == 0


def _kept(spark, texts):
    """Which of some one-line documents keep their line."""
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [i for i, t in sorted((x.doc_id, x.text) for x in lines.dedup(df).collect()) if t]


def test_similar_lines_meet(spark):
    """Against plain edit distance over all pairs."""
    r = random.Random(21)
    words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 8))) for _ in range(600)]
    texts = []
    for n in (1, 2, 3, 5, 7, 10, 20, 40):
        for _ in range(12):
            w = [r.choice(words) for _ in range(n)]
            texts.append(" ".join(w))
            k = r.randrange(n)
            if n >= 10:  # a word in ten or fewer
                w[k] = r.choice(words)
            else:
                w[k] = w[k][:1] + "q" + w[k][2:]
            texts.append(" ".join(w))
    plain = list(dict.fromkeys(texts))
    linked = [(a, b) for b in range(len(plain)) for a in range(b) if lines.edit_distance(plain[a], plain[b], most := max(len(plain[a]), len(plain[b])) // 5) <= most]
    groups = components(range(len(plain)), linked)
    assert len(linked) > 80
    missed = len(_kept(spark, plain)) - len(set(groups.values()))
    assert 0 <= missed <= 1


def test_short_lines_meet_surely():
    r = random.Random(22)
    for _ in range(500):
        a = "".join(r.choice("abé字 ") for _ in range(r.randint(4, 9))).replace(" ", "x")
        k = r.randrange(len(a))
        for b in (a[:k] + a[k + 1 :], a[:k] + "z" + a[k + 1 :]):
            if len(b) >= 4:
                x, y = (set(z) for z in np.stack(lines.blocks(lines.simhashes(lines.normal_lines([a, b])))).T.tolist())
                assert x & y


def test_lines_of_one_word(spark):
    cjk = "".join(chr(0x4E00 + 37 * i % 5000) for i in range(70))
    texts = ["internationalization", "internationalisation", cjk, cjk[:30] + "字" + cjk[31:], "abcd", "abcde", "xyz", "xyw"]
    assert _kept(spark, texts) == [0, 2, 4, 6, 7]


def test_lines_beyond_ascii():
    assert lines.normalised("ÉTÉ À　la  Plage 7!") == "été à la plage 0"
    for text in ("É b\x1cC\n \nD", "A b\x1cC\n \nD"):
        got = lines.normal_lines(["", text, "", text])
        told = [(i, x) for i, line in enumerate(text.split("\n")) if (x := lines.normalised(line))]
        assert list(zip(got.at.tolist(), [x.decode() for x in got.said(np.arange(len(got.id)))], strict=True)) == told * 2
        assert got.text.tolist() == [1] * len(told) + [3] * len(told) and got.size.tolist() == [len(x) for _, x in told * 2]


def test_spark_hash_and_bitmap(spark):
    from ludoscope.llm.common import bitmap, maybe_in, spark_hash, thinned

    df = spark.range(-500, 3000, 7).selectExpr("id * 1234567891011 as x")
    rows = df.select("x", F.xxhash64("x").alias("h")).collect()
    assert spark_hash(np.array([r.x for r in rows])).tolist() == [r.h for r in rows]
    packed = bitmap(df, "x")
    assert maybe_in(packed, np.array([r.h for r in rows])).all()
    others = spark.range(5000).selectExpr("id * 98765 + 1 as x")
    kept = thinned(others, "x", packed).count()
    assert kept < 1000 and kept + thinned(others, "x", packed, inside=False).count() == 5000
    assert thinned(df, "x", packed).count() == len(rows)
    assert not bitmap(df.limit(0), "x").any()


def test_edit_distance():
    def plain(a, b):
        p = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            q = [i]
            for j, y in enumerate(b, 1):
                q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
            p = q
        return p[-1]

    r = random.Random(4)
    for _ in range(1500):
        a, b = ("".join(r.choice("abc") for _ in range(r.randint(0, 12))) for _ in "ab")
        m = r.randint(0, 12)
        assert lines.edit_distance(a, b, m) == min(plain(a, b), m + 1)
        a, b = (" ".join(r.choice(["ab", "c", "bca", "dd"]) for _ in range(r.randint(1, 8))) for _ in "ab")
        assert lines.word_edits(a.split(" "), b.split(" "), 99) >= plain(a, b)
        assert lines.similar_lines(a, b) == (5 * plain(a, b) <= max(len(a), len(b)))


# -- operator 6 -----------------------------------------------------------------------------------


def print_by_hand(text, n=3):
    import xxhash

    w = (text or "").encode().lower().split()
    if not w:
        return 0
    sh = [b" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] or [b" ".join(w)]
    hs = [xxhash.xxh64_intdigest(x, 42) for x in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


@pytest.mark.parametrize("few", [32, 1])
def test_simhash_rows(spark, few):
    rows = [(x.doc_id, x.text) for x in small(spark).collect()] + [(i + 1000, t) for i, t in enumerate(ODD)]
    df = spark.createDataFrame(rows + [(None, "x"), rows[0]], "doc_id long, text string").withColumns({c: F.lit(0) for c in ("rep", "key", "fingerprint")})
    got = simhash.near_duplicates(df, few=few).collect()
    assert len(got) == len(rows) + 2
    prints = {i: print_by_hand(t) for i, t in rows}
    label = components(list(prints), [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 3])
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert (r.fingerprint, r.component_id) == (f"{prints[r.doc_id]:016x}", label[r.doc_id])
    assert simhash.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize(("k", "bits", "few"), [(3, 64, 2), (3, 64, 32), (0, 64, 32), (5, 64, 3), (11, 128, 4)])
def test_links_are_complete(spark, k, bits, few):
    r = random.Random(k)
    centres = [r.getrandbits(bits) for _ in range(12)]
    prints = set(centres)
    for _ in range(500):
        x = r.choice(centres)
        for _ in range(r.randint(0, k + 2)):
            x ^= 1 << r.randrange(bits)
        prints.add(x)
    prints = sorted(prints)
    df = spark.createDataFrame([(i, f"{x:0{bits // 4}x}") for i, x in enumerate(prints)], "rep long, fingerprint string").cache()
    found = [(x.a, x.b) for x in simhash.links(df, k, bits, few).collect()]
    assert all((prints[a] ^ prints[b]).bit_count() <= k for a, b in found)
    true = [(a, b) for a in range(len(prints)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= k]
    assert components(range(len(prints)), found) == components(range(len(prints)), true)
    df.unpersist()


def test_thresholds_are_best():
    from itertools import product

    r = np.random.default_rng(5)
    for m, total in ((3, 1), (4, 0), (2, 2), (4, -1)):
        most = max(total + m - 1, 0)
        costs = [np.sort(r.random((most + 1, 7)), axis=0) for _ in range(m)]
        got = simhash.allocate(costs, total)
        assert (got.sum(axis=0) == total).all()
        for x in range(7):
            def cost(t):
                return sum(costs[i][v, x] for i, v in enumerate(t) if v >= 0)

            best = min(cost(t) for t in product(range(-1, most + 1), repeat=m) if sum(t) == total)
            assert abs(cost(got[:, x]) - best) < 1e-9


def test_long_text_in_runs_has_the_same_print(monkeypatch):
    text = "One two three four FIVE six " * 40 + "\tseven"
    whole = [simhash.fingerprint(text, n, 128, repeats=x) for n in (1, 3) for x in (True, False)]
    monkeypatch.setattr(simhash, "RUN", 10)
    monkeypatch.setattr(simhash, "word_runs", lambda t, w=simhash.word_runs: w(t, 10))
    assert [simhash.fingerprint(text, n, 128, repeats=x) for n in (1, 3) for x in (True, False)] == whole


def test_merging_by_ranks_is_merging_by_pairs():
    """Each token of the vocabulary comes about by its own pair alone, so that merging by the
    rank of what results can't differ from merging by the list of pairs."""
    import json

    told = json.load(open(P.path("word_bpe_49k.json")))["model"]
    merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in told["merges"]]
    order = {m: i for i, m in enumerate(merges)}
    assert len({a + b for a, b in merges}) == len(merges)
    ids = [told["vocab"][a + b] for a, b in merges]
    assert ids == sorted(ids)
    for a, b in merges:
        whole = a + b
        stem = whole.removesuffix("</w>")
        parts = list(stem[:-1]) + [stem[-1] + whole[len(stem) :]]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: order.get((parts[i], parts[i + 1]), 1 << 30))
            assert (parts[best], parts[best + 1]) in order
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        assert parts == [whole]


def test_crowds_of_a_task_move_once(spark):
    from ludoscope.llm.graph import in_parts

    rows = spark.range(5 * lines.TOGETHER // 2).selectExpr("if(id < 2000, 1, 2) AS key", "id AS line")
    counts = rows.groupBy("key").agg(F.count("*").alias("__count"))
    got = in_parts(rows, ["key"], "line", counts, most=lines.TOGETHER).groupBy("key").agg(F.count("*").alias("n")).collect()
    assert {r["key"]: r["n"] for r in got} == {1: 2000, 2: (5 * lines.TOGETHER // 2 - 2000) * -(-(5 * lines.TOGETHER // 2 - 2000) // (lines.TOGETHER // 2))}


def test_edit_distances_side_by_side():
    rng = random.Random(5)
    for alphabet in ("ab", "abcdefgh ", "".join(map(chr, range(0x4E00, 0x4F90)))):
        for size in (3, 64, 65, 300, 700):
            pairs, most = [], []
            for _ in range(40):
                a = [rng.choice(alphabet) for _ in range(size)]
                b = a[size // 8 :] + a[: size // 8] if rng.random() < 0.2 else list(a)
                for _ in range(rng.randrange(size // 3 + 1)):
                    k = rng.randrange(len(b))
                    b[k : k + 1] = [rng.choice(alphabet)] * rng.randrange(3)
                    b = b or ["a"]
                x, y = sorted(("".join(a), "".join(b)), key=len, reverse=True)
                pairs.append((x, y))
                most.append(max(0, lines.edit_distance(x, y, 10**6) - rng.randrange(2)))
            got = lines._myers(*map(list, zip(*pairs)), np.array(most))
            assert got.tolist() == [lines.edit_distance(x, y, m) <= m for (x, y), m in zip(pairs, most)]


def test_workers_collect_cycles_after_packing(spark):
    import gc

    import pyarrow as pa

    docs = spark.createDataFrame([(i, "a few words") for i in range(8)], "doc_id long, text string").repartition(8)
    packing.pieces(docs, P.path("word_bpe_49k.json")).collect()

    def told(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([gc.isenabled()] * b.num_rows)], ["on"])

    assert all(r["on"] for r in spark.range(0, 8, 1, 8).mapInArrow(told, "on boolean").collect())
