"""Operators 11 to 13 against plain loops and brute force."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ludoscope.llm import dialogue, lines, manifest, personal, quality, toxicity, wording

DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string"


# -- Merkle manifest -------------------------------------------------------------------------


def by_hand(docs):
    """Every proof from whole lists of levels."""

    def h(*parts):
        return hashlib.sha256("".join(parts).encode()).hexdigest()

    def leaf(d, text):
        return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (d["doc_id"], d["source"], d["lang"], d["n_chars"], text)))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([h(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
        return out

    def path(tree, i):
        for nodes in tree[:-1]:
            run = nodes[i // 8 * 8 : i // 8 * 8 + 8]
            yield run[: i % 8], run[i % 8 + 1 :]
            i //= 8

    langs = {}
    for d in docs:
        langs.setdefault(d["lang"], []).append(d)
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang, own in langs.items():
        own.sort(key=lambda d: (d["doc_id"] is not None, d["doc_id"] or 0, leaf(d, d["text"])))
        trees[lang] = levels([leaf(d, d["text"]) for d in own])
    top = levels([trees[x][-1][0] for x in order])
    out = []
    for k, lang in enumerate(order):
        for i, d in enumerate(langs[lang]):
            own, text = leaf(d, d["text"]), d["text"]
            proof = [*path(trees[lang], i), *path(top, k)]
            if d["doc_id"] is not None and zlib.crc32(str(d["doc_id"]).encode()) % 3 == 0 and text is not None:
                text = re.sub("[A-Z]", lambda m: m.group().lower(), text)
            node = leaf(d, text)
            for left, right in proof:
                node = h(*left, node, *right)
            root = top[-1][0]
            out.append((d["doc_id"], own, trees[lang][-1][0], root, h(*(x for left, right in proof for x in (*left, *right))), node, node == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("band", [1, 4])
def test_manifest(spark, band):
    rng = random.Random(5)
    docs = [{"doc_id": i, "text": rng.choice(["", "Ab cD", "é" * 9, None, "low"]), "lang": "en" if i % 3 else "de", "source": "s", "n_chars": i} for i in range(150)]
    docs += [{"doc_id": i, "text": "T", "lang": f"l{i}", "source": None, "n_chars": None} for i in range(200, 210)]  # trees of one leaf, more than a run of them
    docs += [{"doc_id": None, "text": "No id", "lang": None, "source": "", "n_chars": 1}, {"doc_id": 3, "text": "Again", "lang": "de", "source": "s", "n_chars": 3}, {"doc_id": 7, "text": "", "lang": None, "source": "", "n_chars": 0}]
    docs += [dict(docs[4])] * 2  # equal rows
    rows = spark.createDataFrame([(*(d[c] for c in ("doc_id", "text", "lang", "source", "n_chars")), "x") for d in docs], DOCS).repartition(3)
    got = manifest.prove_tampered(rows, band)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=repr) == by_hand(docs)


def test_manifest_gives_proofs_and_takes_nothing(spark):
    rows = spark.createDataFrame([(i, f"T{i}", "en", "s", i, "x") for i in range(70)], DOCS)
    for r in manifest.prove(rows, ["doc_id", "text"], proofs=True).collect():
        assert r.verified and hashlib.sha256("".join(r.proof).encode()).hexdigest() == r.proof_sha256 and len(r.proof) == 3
    assert manifest.prove_tampered(rows.limit(0)).collect() == []


def test_sweeps_of_a_block():
    """Sweeps of one block against digests level by level."""
    nodes = [manifest.digest(str(i)) for i in range(100)]
    top, children = manifest.forward(nodes, 3)
    suffixes = manifest.backward(children, 3, ("l", "r", None))
    assert [manifest.folded(n, s) for n, s in zip(nodes, suffixes)] == [manifest.digest("l", top, "r")] * 100


# -- conversation repair ------------------------------------------------------------------------


def cheapest(rows):
    """The best (cost, audit, repaired) over all targets and alignments. ``rows``: role, text, must go, truncated."""
    best = None
    for s, pairs in itertools.product((0, 1), range(len(rows) + 2)):
        target = "s" * s + "ua" * pairs
        if s and not pairs:
            continue

        def walk(i, k, cost, audit, out):
            nonlocal best
            if best is not None and cost > best[0]:
                return
            if i == len(rows) and k == len(target):
                best = min(best or (cost, audit, out), (cost, audit, out))
                return
            if i < len(rows):
                role, text, must_go, truncated = rows[i]
                walk(i + 1, k, cost + 2, audit + "D", out)
                if k < len(target) and not must_go:
                    extra = 5 * truncated
                    if role[:1] == target[k]:
                        walk(i + 1, k + 1, cost + extra, audit + "K", (*out, f"{role}:{text}"))
                    if target[k] != "s":
                        walk(i + 1, k + 1, cost + 1 + extra, audit + "R", (*out, f"{dialogue.NAMES[target[k]]}:{text}"))
            if k < len(target) and target[k] != "s":
                walk(i, k + 1, cost + 5, audit + "I", (*out, f"{dialogue.NAMES[target[k]]}:"))

        walk(0, 0, 0, "", ())
    return best[0], best[1], hashlib.sha256("\n".join(best[2]).encode()).hexdigest()


def test_repair_is_cheapest():
    rng = random.Random(3)
    for _ in range(400):
        rows = [(rng.choice(["user", "assistant", "system", " ", "tool", ""]), str(i), rng.random() < 0.15, rng.random() < 0.2) for i in range(rng.randrange(6))]
        one = dialogue.Repair()
        for r in rows:
            one.row(*r)
        assert one.end() == cheapest(rows), rows


def test_long_repair_puts_letters_away():
    rng = random.Random(4)
    rows = [(rng.choice(["user", "assistant", "system"]), "t.", rng.random() < 0.1, rng.random() < 0.1) for _ in range(700)]
    got = []
    for every in (7, 10_000):
        one = dialogue.Repair()
        one.EVERY = every
        for r in rows:
            one.row(*r)
        got.append((one.end(), len(next(iter(one.tops.values()))[1])))
    assert got[0][0] == got[1][0] and got[0][1] < 60 < got[1][1]


def conversations_by_hand(rows):
    groups = {}
    for conv, turn, role, text in rows:
        own = groups.setdefault(conv, [])
        said = [" " if v is None else str(v) for v in (conv, turn)]
        kind = zlib.crc32(":".join(said).encode()) % 20
        role, text = (" " if v is None else v for v in (role, text))
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = []
    for conv, own in groups.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        seen, faults, parsed = set(), {"blank": 0, "duplicate": 0, "truncated": 0}, []
        for _, role, text in own:
            if not re.search(r"[^\x20\x09-\x0D]", text):
                fault = "blank"
            elif (role, text) in seen:
                fault = "duplicate"
            else:
                fault = "" if re.findall(r"[^\x20\x09-\x0D]", text)[-1] in ".!?" else "truncated"
            seen.add((role, text))
            if fault:
                faults[fault] += 1
            parsed.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        out.append((conv, gaps, *faults.values(), illegal, *cheapest(parsed)))
    return sorted(out, key=repr)


def test_repair_of_tables(spark):
    rng = random.Random(6)
    texts = ["Yes.", "No", "", " \t", "Why?", None, "é!", "x" * 5000 + "."]
    rows = [(c, t if rng.random() < 0.9 else None, rng.choice(["user", "assistant", "system", None, ""]), rng.choice(texts)) for c in [*range(40), None] for t in range(rng.randrange(1, 6)) if t != 3]
    rows += [rows[0]] * 2  # repeated rows
    df = spark.createDataFrame([(*r, "c") for r in rows], "conv_id long, turn long, role string, text string, seen string").repartition(3)
    damaged = dialogue.damage(df)
    report = dialogue.repair(damaged)
    assert sorted(map(tuple, report.collect()), key=repr) == conversations_by_hand(rows)
    fixed = dialogue.repaired(damaged, report)
    spelt = F.concat_ws("\n", F.transform(F.sort_array(F.collect_list(F.struct("place", "role", "text"))), lambda x: F.concat(x["role"], F.lit(":"), x["text"])))
    texts = {r.conv_id: r.t for r in fixed.groupBy("conv_id").agg(spelt.alias("t")).collect()}
    for r in report.collect():
        assert hashlib.sha256(texts.get(r.conv_id, "").encode()).hexdigest() == r.repaired_sha256
    assert dialogue.repair(dialogue.damage(df.limit(0))).collect() == []
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    alone = spark.createDataFrame([(gone, 0, "user", "Hm.")], "conv_id long, turn long, role string, text string")
    assert tuple(dialogue.repair(dialogue.damage(alone)).first()) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


# -- personal data ------------------------------------------------------------------------------

#: The contract's patterns, as they stand there.
PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def rules_by_hand(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m.group() if c in "0123456789"]
            if kind == 1 and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == 2:
                doubled = [d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(reversed(digits))]
                if not 16 <= len(digits) <= 19 or sum(doubled) % 10:
                    continue
            if kind == 3 and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


def test_rules():
    rng = random.Random(8)
    seen = [0, 0, 0, 0]
    for alphabet in ("0123456789.", "ab@.-", "a1.@+- ", "0123456789 -", "+1 ().-9", "é1@.ü4 "):
        for _ in range(1500):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(60)))
            got = personal.by_rules(text)
            assert got == rules_by_hand(text), text
            for k, _, _ in got:
                seen[k] += 1
    assert min(seen) > 5
    for text in ("a" * 300_000 + "@", "1" * 300_000, "1." * 100_000, "+1" + " " * 300_000, "@" * 300_000, "1 " * 100_000):
        personal.by_rules(text)  # each run is gone through once: no quadratic time


def field(held, joined, equal, similar, inputs=None):
    n = len(held)
    doc = np.zeros(n, dtype=np.int64)
    return personal.Field.of(doc, np.array(inputs or [1] * n), np.array(held), np.array(joined), np.array(equal), np.array(similar))


def exact(f, w):
    """Chances of the labels by going through all assignments of tokens and hubs."""
    n, hubs, more = len(f.held), f.equal.max() + 1, f.similar.max() + 1
    total = np.zeros((n, personal.LABELS))
    for ys in itertools.product(range(personal.LABELS), repeat=n + hubs + more):
        if any(h and h != y for h, y in zip(f.held, ys)):
            continue
        if any(h and k >= 0 and ys[at + k] != h for at, hub in ((n, f.equal), (n + hubs, f.similar)) for h, k in zip(f.held, hub)):
            continue
        score = sum(f.inputs[i] @ w.inputs[:, ys[i]] for i in range(n) if not f.held[i])
        for i in range(n):
            score += w.next[ys[i - 1] if f.joined[i] else 0, ys[i]]
            if i + 1 == n or not f.joined[i + 1]:
                score += w.next[ys[i], 0]
            score += w.equal[ys[n + f.equal[i]], ys[i]] if f.equal[i] >= 0 else 0
            score += w.similar[ys[n + hubs + f.similar[i]], ys[i]] if f.similar[i] >= 0 else 0
        for i in range(n):
            total[i, ys[i]] += np.exp(score)
    return total / total.sum(axis=1, keepdims=True)


def test_messages_are_exact_without_loops():
    rng = np.random.default_rng(1)
    w = personal.Weights(rng.normal(size=(personal.INPUTS, 5)), *(rng.normal(size=(5, 5)) for _ in range(3)))
    for held, joined, equal, similar in (
        ([0, 0, 0, 0], [False, True, True, False], [0] * 4, [0] * 4),
        ([2, 0, 0, 0], [False, False, False, True], [9, 9, 9, 0], [0] * 4),
        ([0, 3, 0], [False, False, False], [5, 5, 0], [0, 6, 6]),
    ):
        f = field(held, joined, equal, similar)
        assert np.allclose(personal.beliefs(f, w), exact(f, w), atol=1e-6)
    f = field([1, 0, 0], [False, False, True], [4, 4, 4], [0, 0, 0])  # a loop: near, and the same order
    w = personal.Weights(w.inputs / 4, *(x / 4 for x in (w.next, w.equal, w.similar)))
    assert np.abs(personal.beliefs(f, w) - exact(f, w)).max() < 0.02


CARD, PLAIN = "4539578763621486", "4539578763621487"  # passes the check sum, and doesn't


def test_find(spark):
    rng = random.Random(9)
    filler = ["the of and erst", "Que la.", "x 12 y", f"id {PLAIN}", "in 2024, 555-1234"]

    def some():
        return [f"me.{rng.randrange(100, 999)}@mail{rng.randrange(9)}.example.com", ".".join(str(rng.randrange(256)) for _ in range(4)), f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}"]

    docs = [f"{rng.choice(filler)} {rng.choice(some())} {rng.choice(filler)}" for _ in range(120)] + [f"pay {CARD} now", None, "", "é" * 70_000 + f" {CARD}"]
    told = {
        "write joe.77@mail1.example.com or to joe.77, says Joe.77!": ["joe.77@mail1.example.com", "joe.77", "Joe.77"],
        "at 10.20.30.40 and 10-20-30-40 but not 10-20-30-41": ["10.20.30.40", "10-20-30-40"],
        "call +1 (743) 555-3824, again (743) 555-3824 or 743-555-3824": ["+1 (743) 555-3824", "(743) 555-3824", "743-555-3824"],
        f"card {CARD}; 4539.5787.6362.1486; no {PLAIN}": [CARD, "4539.5787.6362.1486"],
        f"no {PLAIN} here, {PLAIN} there, 743-555-3824": [],
    }
    rows = [(i if t is not None else None, t, "x", 0) for i, t in enumerate([*docs, *told])] + [(0, docs[0], "y", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kinds string, start int").repartition(3)
    got = personal.find(df)
    assert got.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    got = got.collect()
    assert len(got) == len(rows)
    for r in got:
        text = (docs + list(told))[r.doc_id] if r.doc_id is not None else ""
        base = rules_by_hand(text)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, _, _ in base) for x in range(4)]
        assert r.base_sha256 == hashlib.sha256(personal.written_out(base).encode()).hexdigest()
        if text in told:
            assert [text[int(a) : int(b)] for _, a, b in (x.split(":") for x in r.spans.split(",") if x)] == told[text], r.spans
        else:
            assert r.spans == personal.written_out(base), text
    assert personal.find(df.limit(0)).collect() == []
    nothing = spark.createDataFrame([(1, "no 743-555-3824")], "doc_id long, text string")
    assert personal.find(nothing).first().spans == ""


# -- long texts, and lines side by side -----------------------------------------------------------


@pytest.mark.parametrize("run", [1, 5, 60, 400])
def test_parts_of_long_texts_change_nothing(monkeypatch, run):
    """Features and scores are the same wherever long texts are cut."""
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["the", "THE", "x!", "a1", "b--c", "über", "x", "??", "\n", "  "]) for _ in range(n)) for n in (0, 1, 3, 15, 16, 17, 40, 333)]
    texts += ["   " * 50, " a" + " " * 60 + "b  "]
    net = toxicity.new_net()

    def told():
        got = list(quality.features(texts))
        text, bucket = (np.concatenate([g[k] for g in got]) for k in (0, 1))
        return [np.sort(bucket[text == i]).tolist() for i in range(len(texts))], sum(g[2] for g in got).tolist()

    want, scores = told(), toxicity.score_texts(net, texts)
    monkeypatch.setattr(wording, "RUN", run)
    assert told() == want
    assert np.abs(toxicity.score_texts(net, texts) - scores).max() < 1e-6
    whole = toxicity.Text(texts[-3], 1)
    assert len(whole.number) == len(wording.words([texts[-3].encode()]).start) and whole.begin[-1] == len(whole.tri)


def test_distances_side_by_side(monkeypatch):
    """Bit vectors of many pairs, of one or more words, with carries between them."""
    rng = random.Random(1)
    xs, ys = [], []
    for _ in range(1200):
        n = rng.choice([0, 1, 3, 20, 63, 64, 65, 100, 128, 129, 300])
        a = "".join(rng.choice("abcdé 丈") for _ in range(n))
        b = list(a)
        for _ in range(rng.randrange(0, max(1, n // 2) + 1)):
            i = rng.randrange(len(b) + 1)
            b[i : i + rng.randrange(2)] = rng.choice(["", "x", "a", " "])
        xs.append(a)
        ys.append("".join(b))
    most = np.array([max(len(a), len(b)) // 5 for a, b in zip(xs, ys)])
    want = [lines.edit_distance(a, b, m) <= m for a, b, m in zip(xs, ys, most.tolist())]
    assert 200 < sum(want) < 1000
    monkeypatch.setattr(lines, "MANY", 1)
    assert lines.close_pairs(xs, ys, most).tolist() == want
    assert lines.similar_pairs(xs, ys).tolist() == want


@pytest.mark.parametrize("many", [1, 64])
def test_crowds(monkeypatch, many):
    """Links of crowds connect what all pairs connect; crowds come in batches cut anywhere."""
    import pyarrow as pa

    monkeypatch.setattr(lines, "MANY", many)
    rng = random.Random(7)
    rows = []
    for key in range(12):
        bases = ["".join(rng.choice("abcdef ") for _ in range(rng.choice([30, 60]))).strip() for _ in range(6)]
        for k in range(rng.choice([5, 70])):
            said = list(rng.choice(bases))
            for _ in range(rng.randrange(8)):
                said[rng.randrange(len(said))] = rng.choice("xyz")
            rows.append((key, 0, 0, key * 1000 + k, "".join(said), 0, 0, key * 1000 + (k if rng.random() < 0.8 else 0)))
    table = pa.table(dict(zip(("key", "__i", "__j", "line", "said", "w0", "w1", "g_line"), map(list, zip(*rows)))))
    got = [tuple(r) for x in lines.crowd_links(lines._crowds(iter(table.to_batches(max_chunksize=17)))) for r in x.tolist()]

    def joined(edges):
        of = {r[3]: r[3] for r in rows}

        def top(x):
            while of[x] != x:
                x = of[x]
            return x

        for a, b in [*edges, *((r[3], r[7]) for r in rows if r[7] in of)]:
            of[top(a)] = top(b)
        return {frozenset(x for x in of if top(x) == t) for t in map(top, of)}

    texts = {r[3]: r[4] for r in rows}
    every = [(a[3], b[3]) for a, b in itertools.combinations(rows, 2) if a[0] == b[0] and lines.similar_lines(a[4], b[4])]
    assert all(lines.similar_lines(texts[a], texts[b]) for a, b in got)
    assert joined(got) == joined(every)


def test_near_dedup_keeps_clashing_columns(spark):
    from ludoscope.llm import shingles

    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text, "a", 5, "k"), (2, text + " more", "b", 6, "l"), (3, "other words are here", "c", 7, None), (None, text, "d", 8, "m"), (4, None, "e", 9, "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string, id int, `a.b` string").withColumn("__t", F.lit(1)).withColumn("__id", F.lit(2)).withColumn("t", F.lit(3))
    got = shingles.without_later(df, k=11, bits=128)
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(*r, 1, 2, 3) for r in rows if r[0] != 2], key=repr)


def _known(spark, rows):
    """Lines as (line, w0, w1, size, the number of all their tables) as a table of classes."""
    schema = f"line long, first long, last long, {', '.join(f'{w} long' for w in lines.WORDS)}, size int"
    return spark.createDataFrame([(line, line, line, w0, w1, *(line if t is None else t for _ in lines.WORDS[2:]), size) for line, w0, w1, size, t in rows], schema)


def test_chance_meetings_of_keys_are_no_rows(spark):
    """Two lines of a key whose SimHashes or lengths rule them out give nothing; others a pair,
    once; keys of more lines than a few give their lines."""
    rows = [(1, 0, 0, 100, 7), (2, -1, -1, 100, 7)]  # all bits differ
    rows += [(11, 5, 5, 100, 8), (12, 5, 5, 126, 8)]  # over a fifth longer
    rows += [(21, 9, 9, 100, 9), (22, 9, 8, 110, 9), (23, 8, 9, 105, 9)]
    rows += [(31, 0, 0, 40, 10), (32, -1, -1, 40, 10)]  # short lines are not told by SimHashes
    known = _known(spark, rows)
    got = lines.met_keys(known, slice(5, 6), len(rows), 16).collect()
    assert sorted((r["a"], r["b"]) for r in got if r["b"] is not None) == [(21, 22), (21, 23), (22, 23), (31, 32)]
    assert not [r for r in got if r["b"] is None]
    many = _known(spark, [(k, 3, 3, 100, 7) for k in range(100, 120)])
    for df in (many.coalesce(1), many.repartition(20)):
        got = lines.met_keys(df, slice(5, 6), 20, 16).collect()
        assert sorted((r["a"], r["b"]) for r in got) == [(k, None) for k in range(100, 120)] and len({r["key"] for r in got}) == 1


def test_a_crowd_of_copies_is_compared_about_once_a_line(monkeypatch):
    rng = random.Random(9)
    base = [rng.choice(["alpha", "beta", "gamma", "delta", "eps"]) for _ in range(20)]
    said = [" ".join([*base[:k], f"x{i}", *base[k + 1 :]]) for i in range(300) for k in [rng.randrange(20)]]
    calls = []
    plain = lines.word_edits
    monkeypatch.setattr(lines, "word_edits", lambda *a: calls.append(1) or plain(*a))
    ids = np.arange(len(said))
    got = np.concatenate(list(lines.crowd_links(iter([(ids, said, np.zeros((len(said), 2), np.uint64), ids)]))))
    assert len(set(got.ravel().tolist())) == len(said) and len(calls) < 2 * len(said)


def test_places_of_lost_lines(spark):
    """Similar and repeated lines of one text, and texts of one id."""
    one, two = "a line of some ten words that is said here again", "a line of some ten words that was said here again"
    rows = [(1, f"{one}\n{two}\n{two}\n\nx y\nx y"), (2, f"{two}\n{one}\nsomething else entirely, no more"), (3, "p q r\nown"), (3, "own\np q r\np q r"), (None, "p q r\nlast one"), (4, None), (5, "\n\n")]
    got = {(r.doc_id, r.n_lines, r.n_removed, r.text) for r in lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 6, 3, f"{one}\n\nx y"), (2, 3, 2, "something else entirely, no more"), (3, 2, 0, "p q r\nown"), (3, 3, 1, "own\np q r"), (None, 2, 1, "last one"), (4, 1, 0, ""), (5, 3, 0, "\n\n")}


def test_crowds_share_what_is_known(monkeypatch):
    """Crowds of a task that have pairs in common compare each once, linked or not; pairs that wait, too."""
    rng = random.Random(11)
    words = ["alpha", "beta", "gamma", "delta", "eps"]
    base = [rng.choice(words) for _ in range(20)]
    said = [" ".join([*base[:k], f"x{i}", *base[k + 1 :]]) for i in range(40) for k in [rng.randrange(20)]]
    halves = rng.sample(words * 6, 30), rng.sample(words * 6, 30)
    said += [" ".join(rng.sample(halves[k % 2], 30)) for k in range(40)]  # of like letters, but apart
    ids, hashes = np.arange(len(said)), np.zeros((len(said), 2), np.uint64)
    seen = []
    exactly = lines.exactly_close
    monkeypatch.setattr(lines, "exactly_close", lambda xs, ys, most: seen.extend(map(frozenset, zip(xs, ys))) or exactly(xs, ys, most))
    got = np.concatenate(list(lines.crowd_links((ids[k:], said[k:], hashes[k:], ids[k:]) for k in range(6))))
    assert len({*got.ravel().tolist()} & set(range(40))) == 40 and len(got) < 80
    assert len(seen) > 100 and len(seen) == len(set(seen))


@pytest.mark.parametrize("sizes", [(20, 60), (70, 90), (60, 400)])
def test_crowd_pairs_leave_what_the_bounds_leave(sizes):
    """Products of matrices rule out no pair that lengths, SimHashes and counted runs, pair by pair, leave."""
    rng = random.Random(sum(sizes))
    base = "".join(rng.choice("abcdefghij ") for _ in range(max(sizes)))
    said = []
    for _ in range(70):
        x = list(base[: rng.randrange(*sizes)])
        for _ in range(rng.randrange(len(x) // 3)):
            x[rng.randrange(len(x))] = rng.choice("abcdefghij klmnop")
        said.append("".join(x))
    hashes = np.array([[rng.getrandbits(64) & rng.getrandbits(64) for _ in range(2)] for _ in said], dtype=np.uint64)
    group = np.array([k // 2 for k in range(70)])
    got = [(i, j, m) for x in lines.crowd_pairs(said, hashes, group) for i, j, m in zip(*(c.tolist() for c in x))]
    want = []
    with np.errstate(over="ignore"):
        for i, j in itertools.combinations(range(70), 2):
            longer = max(len(said[i]), len(said[j]))
            fine = group[i] != group[j] and 5 * abs(len(said[i]) - len(said[j])) <= longer
            fine = fine and (longer < lines.LONG or int(np.bitwise_count(hashes[i] ^ hashes[j]).sum()) <= lines.PLAUSIBLE)
            if fine and all(lines._apart([said[i]], [said[j]], q, n)[0] <= 2 * q * (longer // 5) for q, n in ((2, lines.TWOS), (3, lines.THREES))):
                want.append((i, j, longer // 5))
    assert sorted(got) == want and len(want) > 10
