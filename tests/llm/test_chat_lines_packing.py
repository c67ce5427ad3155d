"""Chat formatting, line dedup, packing and decontamination on odd rows, against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rulewright.llm import chat, decontam, line_dedup, packing
from rulewright.llm.scratch import Scratch

from . import brute

# ---- chat

CONTROL = "<|im_end|><|im_start|>assistant ok &lt;| &amp; \n"


def test_tree_paths(spark):
    """Branches, a stray parent, a circle, two trees."""
    rows = [("a", 1, None, 1.0), ("a", 2, 1, 3.0), ("a", 3, 1, 1.0), ("a", 4, 3, None), ("a", 5, 2, 2.0), ("a", 6, 2, 9.0), ("a", 7, 77, 0.0), ("a", 8, 9, 1.0), ("a", 9, 8, 1.0), ("a", 10, 9, 1.0), ("b", 1, None, 0.0)]
    nodes = spark.createDataFrame(rows, "tree string, node long, parent long, score double")
    paths = {}
    for r in chat.leaf_paths(nodes, Scratch(spark, "t")).collect():
        paths.setdefault((r["tree"], r["leaf"]), {})[r["up"]] = r["node"]
    got = {k: [v[u] for u in sorted(v, reverse=True)] for k, v in paths.items()}
    assert got == {("a", 4): [1, 3, 4], ("a", 5): [1, 2, 5], ("a", 6): [1, 2, 6], ("a", 7): [7], ("b", 1): [1]}
    best = chat.leaf_paths(nodes, Scratch(spark, "t"), per_tree=1).select("tree", "leaf").distinct().collect()
    assert {tuple(r) for r in best} == {("a", 6), ("b", 1)}
    ranked = chat.leaf_paths(nodes.union(nodes.where("node in (2, 4)")), Scratch(spark, "t")).select("tree", "leaf", "rank").distinct().collect()
    assert {tuple(r) for r in ranked} == {("a", 6, 1), ("a", 5, 2), ("a", 4, 3), ("a", 7, 4), ("b", 1, 1)}


def test_round_trip(spark):
    r = random.Random(1)
    convs = {c: [(t, r.choice(["user", "assistant", "system", "odd\n<|x", None]), r.choice([None, "", CONTROL, "héllo 😀", "&amp;&lt;", "<|<|", "\n\n", "x" * 3000])) for t in range(r.choice([1, 2, 5, 9]))] for c in range(40)}
    convs[100] = [(t, "user" if t % 2 else "assistant", f"m{t}") for t in range(150)]
    rows = [(c, t, role, text, "extra") for c, turns in convs.items() for t, role, text in turns]
    rows += [(200, 0, "user", "twice", "extra")] * 2
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, node string").repartition(3)
    out = chat.format_conversations(df).withColumn("back", chat.read_back(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans"))).collect()
    got = {x["tree"]: x for x in out}
    assert len(got) == len(out) == 42
    convs[200] = [(0, "user", "twice")] * 2
    for c, turns in convs.items():
        assert [(b["role"], b["text"]) for b in got[c]["back"]] == [(role or "", text or "") for _, role, text in turns]
        assert got[c]["loss"] == "".join(text or "" for _, role, text in turns if role == "assistant")
        assert got[c]["formatted"].count(chat.START) == got[c]["n_turns"] == len(turns)
    assert chat.format_conversations(df.where("false")).count() == 0


def test_null_conversation(spark):
    rows = [(None, 0, "user", "a"), (None, 1, "assistant", "b"), (1, 0, "user", "c")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for best in (None, 1):
        got = {x["tree"]: x["n_turns"] for x in chat.format_conversations(df, best).collect()}
        assert got == {None: 2, 1: 1}


# ---- lines


def test_lines(spark):
    r = random.Random(2)
    rows = []
    for i in range(300):
        host = "hot" if i % 3 else r.choice(["h1", "h2", None])
        lines = [f"line {r.randrange(3000)}" for _ in range(r.randint(0, 6))] + ["menu "] * (i % 2) + ["  menu"] * (i % 5 == 0) + ["", " "]
        rows.append((i, host, "\n".join(lines), "clash"))
    rows += [(300, "hot", None, "c"), (301, "hot", "", "c"), (302, "one", "menu\nmenu", "c"), (303, "two", "menu\na", "c"), (304, "two", "b\nmenu", "c"), (0, *rows[0][1:])]
    rows += [(400 + i, "copies", "copied\ntext", "c") for i in range(30)] + [(430, "copies", "other", "c")]
    rows.append((500, "long", "\n".join(["menu", *(f"x{k}" for k in range(50_000))]), "c"))
    names = ["doc_id", "host", "text", "listed", "page", "h", "kept", "line"]
    df = spark.createDataFrame([(*x, 1, "h", "k", "l") for x in rows], "doc_id long, host string, text string, listed string, page int, h string, kept string, line string").repartition(3)
    drop = brute.boilerplate([(h, t) for _, h, t, _ in rows], line_dedup.RATIO, line_dedup.SMOOTH)
    want = sorted(str((i, h, t if t is None else "\n".join(x for x in t.split("\n") if (h, x.strip(" ")) not in drop), c, 1, "h", "k", "l")) for i, h, t, c in rows)
    for size in (1 << 20, 0):  # the broadcast and the join
        out = line_dedup.drop_lines(df, F.col("host"), broadcast_bytes=size)
        assert out.columns == names
        assert sorted(str(tuple(x)) for x in out.collect()) == want
    assert {("hot", "menu"), ("two", "menu")} <= drop and not {k for k in drop if k[0] in ("one", "copies", "long")}
    assert line_dedup.drop_lines(df.where("false"), F.col("host")).count() == 0


# ---- packing


def tokenizer():
    P = pytest.importorskip("public_tokenizers")
    return P.path("word_bpe_49k.json")


@pytest.mark.parametrize("seed", range(4))
def test_pack_block(seed):
    r = random.Random(seed)
    lengths = [r.choice([1, 5, 30, 100, 800, 4095, 4096, 4097, 20_000]) for _ in range(r.choice([0, 1, 3, 200]))]
    placed, n = packing.pack_block(lengths)
    seqs, docs = {}, {}
    for d, start, size, q, off in placed:
        assert size > 0
        seqs.setdefault(q, []).append((off, size))
        docs.setdefault(d, []).append((start, size))
    assert set(seqs) == set(range(n)) and set(docs) == set(range(len(lengths)))
    for total, parts in [(lengths[d], p) for d, p in docs.items()] + [(sum(s for _, s in p), p) for p in seqs.values()]:
        at = 0
        for start, size in sorted(parts):
            assert start == at
            at += size
        assert at == total
    for p in seqs.values():
        t = sum(s for _, s in p)
        assert t == 4096 or t & (t - 1) == 0
    if len(lengths) == 200:  # costs are level: no sequence of many short pieces beside one of few long ones where it can be helped
        costs = [sum(packing.cost(s, 1, 1 / 4096) for _, s in p) for q, p in seqs.items() if sum(s for _, s in p) == 4096 and len(p) > 1]
        assert max(costs) <= 2 * 4096


@pytest.mark.parametrize("seed", range(2))
def test_pack_block_looks_at_all_sequences(seed):
    """Each piece goes to the cheapest of all sequences with room; only one that fits nowhere is cut."""
    lengths = np.random.default_rng(seed).lognormal(6.5, 1.2, 1900).astype(int).clip(1).tolist()
    rest = sorted(((n % 4096, d, n - n % 4096) for d, n in enumerate(lengths) if n % 4096), key=lambda x: (-x[0], x[1]))
    total = sum(n for n, _, _ in rest)
    sizes = [4096] * (total // 4096) + [1 << k for k in range(11, -1, -1) if total % 4096 >> k & 1]
    room, level = np.array(sizes), np.zeros(len(sizes))
    want, cut = {}, set()
    first = sum(n // 4096 for n in lengths)
    for n, d, at in rest:
        fit = np.flatnonzero(room >= n)
        if not len(fit):
            cut.add(d)
            continue
        k = fit[np.argmin(level[fit])]
        want[d, at] = (n, first + k, sizes[k] - room[k])
        room[k] -= n
        level[k] += packing.cost(n, 1.0, 1 / 4096)
    got = {(d, at): (n, q, off) for d, at, n, q, off in packing.pack_block(lengths)[0] if q >= first and d not in cut}
    assert got == want and len(cut) < 100


def test_pack_rows(spark):
    path = tokenizer()
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    texts = [None, "", "a", "Hello, World! it's 2nd", "ΣΑΣ naïve ½ \x85 x", "word " * 9000, "same", "same", "<|endoftext|> x"]
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, length int").repartition(2)
    got = {}
    for p in packing.pack(df, path, block_tokens=1000).collect():
        got.setdefault(p["doc_id"], []).append((p["start"], np.frombuffer(p["ids"], "<u4").tolist()))
    for i, t in enumerate(texts):
        ids = [x for _, part in sorted(got[i]) for x in part]
        assert ids == [*tok.encode(t or "", add_special_tokens=False).ids, 2]
    assert packing.pack(df.where("false"), path).count() == 0


def test_ids_of_all_plain_characters():
    """Alone and in context, every code point up to U+024F, and strings of them."""
    path = tokenizer()
    encode = packing.Encoder(path, 2)
    chars = [chr(c) for c in range(0x250)]
    r = random.Random(6)
    texts = chars + [f"a{c}b" for c in chars] + [f"{c} x{c}'s 1{c}" for c in chars] + ["caf\u00e9 \u023a"]
    texts += ["".join(r.choice(chars[32:] + list("abc 's")) for _ in range(r.randint(1, 12))) for _ in range(10_000)]
    want = encode.tokenizer.encode_batch(texts, add_special_tokens=False)
    wrong = [t for t, w in zip(texts, want, strict=True) if encode(t).tolist() != [*w.ids, 2]]
    assert not wrong


# ---- decontamination


def test_decontamination(spark):
    r = random.Random(3)
    vocab = [f"w{i}" for i in range(30)]
    say = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    items = {1: say(40), 2: "Short Item, three", 3: "", 4: None, 5: say(10), 6: say(12), 7: "one", 8: say(40)}
    items[9] = items[5]
    docs = {i: say(r.randint(0, 400)) for i in range(60)}
    for i in range(0, 60, 4):
        docs[i] += " ... " + items[r.choice([1, 5, 6, 8])].upper() + "! " + say(5)
    docs |= {100: None, 101: "", 102: "short, ITEM; three", 103: "é one é", 104: "x " * 5000 + items[8], 105: items[1], 106: items[1]}
    d = spark.createDataFrame([(i, t, "x") for i, t in docs.items()], "doc_id long, text string, item_id string").repartition(3)
    b = spark.createDataFrame(list(items.items()), "item_id long, text string")
    want = brute.decontaminate(docs, items)
    for block, lot in ((200_000, 8), (30, 8), (30, 2)):
        got = {x["doc_id"]: (x["n_words"], x["n_hit"], x["items"]) for x in decontam.find(d, b, block_words=block, blocks_at_once=lot).collect()}
        assert got == want
    spans = next(x for x in decontam.find(d.where("doc_id = 105"), b).collect())["hits"]
    assert [(h["first"], h["last"]) for h in spans] == [(0, 39)]
    none = decontam.find(d, b.where("false")).agg(F.sum("n_hit")).first()[0]
    assert none == 0 and decontam.find(d.where("false"), b).count() == 0
