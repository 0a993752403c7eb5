"""Conversation repair, periodic runs and sum-of-squares packing against brute force, with odd rows."""

import hashlib
import random
import re
import time
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest

from wavecrest.llm import best_fit, bpe, queries
from wavecrest.llm import conversation_repair as conv
from wavecrest.llm import periodic_runs as runs

# -- conversation repair ----------------------------------------------------------------------------

CONV = "conv_id long, turn long, role string, text string, h string, copy int, gone string, fault string, _text int"


def cheapest(rows):
    """All edit sequences of (role, text, fault) up to the price of deleting everything: least (cost, audit), repaired lines."""
    best = [(3 * len(rows), "D" * len(rows), [])]

    def go(k, cost, audit, lines):
        if (cost, audit) > best[0][:2] and cost > best[0][0]:
            return
        if k == len(rows):
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "?" for r, _ in lines)):
                best[0] = min(best[0], (cost, audit, lines), key=lambda x: x[:2])
        else:
            role, text, fault = rows[k]
            go(k + 1, cost + 3, audit + "D", lines)
            if fault not in (conv.BLANK, conv.DUPLICATE):
                stays = int(fault == conv.TRUNCATED)
                go(k + 1, cost + stays, audit + "K", [*lines, (role, text)])
                for new in ("user", "assistant"):
                    go(k + 1, cost + 2 + stays, audit + "R", [*lines, (new, text)])
        if cost + 2 <= best[0][0]:
            for new in ("user", "assistant"):
                go(k, cost + 2, audit + "I", [*lines, (new, "")])

    go(0, 0, "", [])
    return best[0]


def report(conv_id, rows):
    """The contract's row for (turn, role, text) of one conversation, step by step."""
    damaged = []
    for turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or " ", r[2] or " ")):
        h = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        row = (turn, "user" if h == 4 else role, "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text)
        damaged += [] if h == 0 else [row] * (2 if h == 3 else 1)
    damaged.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    turns = [t for t, _, _ in damaged if t is not None]
    seen, faults = set(), []
    for _, role, text in damaged:
        last = text.rstrip(" \t\n\v\f\r")[-1:]
        faults.append(conv.BLANK if not last else conv.DUPLICATE if (role, text) in seen else conv.TRUNCATED if last not in ".!?" else conv.FINE)
        seen.add((role, text))
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(damaged, damaged[1:], strict=False)]
    cost, audit, lines = cheapest([(r, t, f) for (_, r, t), f in zip(damaged, faults, strict=True)])
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    text = "\n".join(f"{r}:{t}" for r, t in lines)
    return (conv_id, gaps, *(faults.count(f) for f in (conv.BLANK, conv.DUPLICATE, conv.TRUNCATED)), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256(text.encode()).hexdigest())


def test_repair_equals_all_edits():
    rnd = random.Random(11)
    for _ in range(1500):
        rows = [(rnd.choice(["system", "user", "assistant", "user", "assistant", "tool", "", "s"]), rnd.choice("xyz"), rnd.choice([0, 0, 0, 1, 2, 3])) for _ in range(rnd.randrange(6))]
        pass_ = conv.Repair()
        for r in rows:
            pass_.add(*r)
        cost, audit, lines = cheapest(rows)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()
        assert pass_.close() == (cost, audit, digest), rows


def test_settled_part_changes_nothing(monkeypatch):
    rnd = random.Random(3)
    rows = [(rnd.choice(["system", "user", "assistant"]), str(k), rnd.choice([0, 0, 1, 3])) for k in range(3000)]
    found = []
    for settle in (1, 7, 10**9):
        monkeypatch.setattr(conv, "SETTLE", settle)
        pass_ = conv.Repair()
        for r in rows:
            pass_.add(*r)
        found.append((len(pass_.rows) < 50, pass_.close()))
    assert found[0][0] and found[1][0] and not found[2][0]
    assert found[0][1] == found[1][1] == found[2][1]


def test_repair_of_odd_rows(spark):
    rnd = random.Random(5)
    rows = [(None, 1, "user", "a."), (None, None, None, None), (None, 2, "assistant", "b?"), (7, None, "user", ""), (7, None, "user", "."), (8, 1, None, "x"), (9, 0, "user", "long " * 100_000 + ".")]
    rows += [(i, rnd.choice([None, *range(6)]), rnd.choice(["system", "user", "assistant", "tool", None]), rnd.choice(["One.", "two", " \n", None, "Three!", "é?\t "])) for i in range(60) for _ in range(rnd.randrange(5))]
    by = defaultdict(list)
    for c, *rest in rows:
        by[c].append(tuple(rest))
    df = spark.createDataFrame([(*r, "h", 3, "no", "x", 4) for r in rows], CONV)
    got = {r.conv_id: tuple(r) for r in conv.repair_structure(conv.damage(df)).collect()}
    assert got == {c: report(c, r) for c, r in by.items()}
    assert conv.repair_structure(conv.damage(df.limit(0))).count() == 0


def test_repair_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.register("conversations", pq.read_table(f"{sf_dir}/conversations.parquet"))
    df = conv.op11_conversation_repair(spark, sf_dir)
    rel = con.sql(conv.OP11_SQL)
    assert rel.columns == df.columns
    assert sorted(map(tuple, df.collect())) == sorted(rel.fetchall())


# -- periodic runs ------------------------------------------------------------------------------------


def all_runs(w):
    out = []
    for s in range(len(w)):
        for q in range(1, (len(w) - s) // 4 + 1):
            if s and w[s - 1] == w[s - 1 + q]:
                continue
            e = s + q
            while e < len(w) and w[e] == w[e - q]:
                e += 1
            if e - s >= max(6, 4 * q) and not any(all(w[i] == w[i - r] for i in range(s + r, e)) for r in range(1, q)):
                out.append((s, e - s, q))
    return sorted(out)


def test_runs_equal_all_stretches():
    rnd = random.Random(1)
    found = 0
    for _ in range(3000):
        k, w = rnd.choice([1, 2, 3, 5]), []
        while len(w) < rnd.randrange(80):
            w += [f"w{rnd.randrange(k)}" for _ in range(rnd.randrange(1, 7))] * rnd.choice([1, 1, 2, 4, 6])
        want = all_runs(w)
        number = {x: n for n, x in enumerate(dict.fromkeys(w))}
        assert runs.word_runs(w) == runs.runs_of([number[x] for x in w]) == want, w
        found += len(want)
    assert found > 3000


def test_end_positions_of_states():
    """Each state's own ends are met once, and neighbours are where its words occur."""
    rnd = random.Random(2)
    for _ in range(200):
        row = [rnd.randrange(2) for _ in range(rnd.randrange(1, 40))]
        for e1, e2, size in runs.SuffixAutomaton(row).neighbours(1):
            assert e1 < e2 and row[e1 - size + 1 : e1 + 1] == row[e2 - size + 1 : e2 + 1]
            assert e1 - size < 0 or row[e1 - size] != row[e2 - size]


def test_long_runs_take_linear_time():
    rnd = random.Random(4)
    began = time.process_time()
    assert runs.word_runs(["a"] * 200_000) == [(0, 200_000, 1)]
    assert runs.word_runs([str(k % 777) for k in range(200_000)]) == [(0, 200_000, 777)]
    assert runs.word_runs([str(rnd.randrange(3)) for _ in range(200_000)])
    assert time.process_time() - began < 30


def damaged_words(doc_id, text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    if doc_id is None or not n or h % 10:
        return w
    a = h // 10 % n
    p = 1 + (n - a) // (3 + h // 10 % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def test_runs_of_odd_rows(spark):
    rnd = random.Random(6)
    texts = [None, "", " \n\t", "a " * 30, "a b " * 9 + "c\x0bd\x1ce f " * 5, "é ü\x85 " * 8 + "x", "one two three four five", "w " * 100_000]
    rows = [(k % 37, t) for k, t in enumerate(texts * 5)] + [(None, "x y " * 6), (5, "a " * 30), (5, "a " * 30)]
    rows += [(k, " ".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(60)))) for k in range(300)]
    df = spark.createDataFrame([(i, t, 1, "s", 2.0) for i, t in rows], "doc_id long, text string, start int, key string, n_runs double")
    want = []
    for i, t in rows:
        w = damaged_words(i, t)
        found = all_runs(w) if len(w) < 1000 else [(0, len(w), 1)]
        gone = {k for s, n, q in found for k in range(s + q, s + n)}
        top = max(found, key=lambda r: (r[1], -r[0], -r[2])) if found else (None, None, None)
        text = b" ".join(x for k, x in enumerate(w) if k not in gone)
        want.append((i, len(found), *top, 1000 * top[1] // top[2] if found else None, hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest(), hashlib.sha256(text).hexdigest()))
    out = runs.find_runs(df, damaged=True)
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)
    assert runs.find_runs(df.limit(0)).count() == 0
    plain = runs.find_runs(df.where("doc_id = 5 and text like 'a a%'").limit(1), with_runs=True).first()
    assert plain.collapsed == "a" and [tuple(r) for r in plain.runs] == [(0, 30, 1)]


def test_runs_of_the_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in runs.op12_periodic_runs(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for d in docs:
        w = damaged_words(d.doc_id, d.text)
        if len(w) <= 300:
            assert got[d.doc_id].n_runs == len(all_runs(w))


# -- sum-of-squares packing ----------------------------------------------------------------------------


def check_packing(rows, docs, window=2048, end_id=0):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.tokenizer_path("byte_bpe_50k.json"))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert 0 < at <= window
    want = defaultdict(list)
    for i, t in docs:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, end_id]
        first = len(ids) % window or window
        for k, at in enumerate([0, *range(first, len(ids), window)]):
            own = ids[at : first if not k else at + window]
            want[i].append((k, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
    assert {i: sorted((r.piece, r.start, r.length, r.ids_crc32) for r in p) for i, p in pieces.items()} == {i: sorted(p) for i, p in want.items()}
    return len(sequences), -(-sum(r.length for r in rows) // window)


def test_each_place_has_the_least_squares():
    """Every choice against the sums of squares of all open sequences, counted anew."""
    rnd = random.Random(7)
    window, gaps = 40, []
    state = best_fit.SumOfSquares(window)
    for size in sorted((rnd.randrange(1, window) for _ in range(400)), reverse=True):
        sequence, offset = state.put(size)

        def squares(k, gaps=gaps, size=size):
            after = [g - size * (j == k) for j, g in enumerate(gaps)]
            return sum(after.count(g) ** 2 for g in range(1, window))

        room = [k for k, g in enumerate(gaps) if g >= size]
        if room:
            best = min((squares(k), gaps[k]) for k in room)
            assert (squares(sequence), gaps[sequence]) == best and offset == window - gaps[sequence]
        else:
            assert sequence == len(gaps) and offset == 0
            gaps.append(window)
        gaps[sequence] -= size
    assert [window - g for g in gaps] and state.count.sum() == sum(g > 0 for g in gaps)


@pytest.mark.parametrize("shard", [3, 20_000])
def test_packing_of_odd_rows(spark, shard):
    docs = [(-1, None), (-2, ""), (-3, "x<|endoftext|> y"), (-4, "a" * 30000), (-5, " \n a  b\t c"), (-6, "don't 12 é 😀!!"), (None, "x y"), (-7, "word " * 9000), (-8, "one " * 2047), (-9, "one " * 2048)]
    docs += [(k, "tree river stone " * (k % 50)) for k in range(300)]
    df = spark.createDataFrame([(i, t, 1, "s", 2) for i, t in [*docs, (3, "tree river stone " * 3)]], "doc_id long, text string, piece int, length string, ids int")
    rows = best_fit.pack_best(df, shard_pieces=shard).collect()
    n, least = check_packing(rows, [*docs, (3, "tree river stone " * 3)])
    assert shard == 3 or n <= least + 1
    assert best_fit.pack_best(df.limit(0)).count() == 0
    held = best_fit.pack_best(df.where("doc_id = -6"), with_ids=True).first()
    assert len(held.ids) == held.length and held.ids[-1] == 0


def test_packing_of_the_table(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    n, least = check_packing(best_fit.op13_sum_of_squares_packing(spark, sf_dir).collect(), docs)
    assert n <= least + 1


def test_registered():
    assert {"op11_conversation_repair", "op12_periodic_runs", "op13_sum_of_squares_packing"} <= set(queries.QUERIES)
    assert queries.ORACLES["op11_conversation_repair"] == conv.OP11_SQL
