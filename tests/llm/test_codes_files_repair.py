"""Vector codes, token files and conversation repair, each against brute force or an exact round trip, and on odd tables."""

import hashlib
import itertools
import json
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tallymark.llm import conversation_repair, token_files, vector_codes

# ---------------------------------------------------------------- vector codes


def codes_by_force(rows, parts=8, size=16, rounds=6):
    """[(id, label, code, error)], digest; plain integers and all distances."""
    kept = [(i, lab, [int(np.floor(4096 * float(x))) for x in v]) for i, lab, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    w = len(kept[0][2]) // parts
    cut = [[r[2][p * w : p * w + w] for r in kept] for p in range(parts)]
    books = [[list(x) for x in c[:size]] for c in cut]

    def assign(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        found = [[assign(p, x)[1] for x in cut[p]] for p in range(parts)]
        for p in range(parts):
            for k in range(len(books[p])):
                mine = [x for x, f in zip(cut[p], found[p]) if f == k]
                if mine:
                    books[p][k] = [sum(c) // len(mine) for c in zip(*mine)]
    out = []
    for n, (i, lab, _) in enumerate(kept):
        best = [assign(p, cut[p][n]) for p in range(parts)]
        out.append((i, lab, "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best)))
    return out, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def vector_table(spark, rows):
    """Columns whose names clash with those of the operator."""
    return spark.createDataFrame([(i, lab, v, "x", 1, 2) for i, lab, v in rows], "vec_id long, label int, embedding array<float>, code string, error int, salt int")


def check_codes(spark, rows):
    want, digest = codes_by_force(rows)
    errors = {}
    for _, lab, _, e in want:
        errors[lab] = errors.get(lab, 0) + e
    got = vector_codes.compress_vectors(vector_table(spark, rows)).collect()
    assert len(got) == len(want)
    assert sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in got) == sorted((str(i), c, e, errors[lab], digest) for i, lab, c, e in want)


def test_codes_by_force(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), int(rng.integers(3)), [float(x) for x in rng.normal(size=16)]) for i in rng.permutation(300)]
    check_codes(spark, rows)


def test_codes_with_ties_and_odd_rows(spark):
    """Vectors on a coarse grid have many equal distances and equal entries."""
    rng = np.random.default_rng(5)
    rows = [(int(i // 2), [None, 1, 2][i % 3], [float(x) / 4096 for x in rng.integers(-2, 3, 16)]) for i in range(400)]
    rows += [(None, None, [0.5] * 16), (7, 1, None), (8, 1, [None] + [1.0] * 15), (9, 1, [float("nan")] * 16), (10, 1, [float("inf")] + [0.0] * 15)]
    check_codes(spark, rows)
    check_codes(spark, [(3, 1, [-0.3] * 16), (2, None, [0.0] * 16)])  # fewer rows than entries
    assert vector_codes.compress_vectors(vector_table(spark, rows).limit(0)).count() == 0


def test_codes_expand(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(16, 16))
    rows = [(i, 0, [float(x) for x in centres[i % 16]]) for i in range(64)]
    codes, books = vector_codes.compress(vector_table(spark, rows))
    for r in vector_codes.expand(codes, books).collect():
        assert np.abs(np.array(r.vector) - centres[r.vec_id % 16]).max() <= 1 / 4096


def test_tree_finds_the_lowest_of_equal_entries():
    rng = np.random.default_rng(7)
    for size in (1, 2, 3, 16, 40):
        entries = rng.integers(-3, 4, (size, 3))
        x = rng.integers(-5, 6, (500, 3))
        index, far = vector_codes.nearest(vector_codes.build(entries), entries, x)
        d = ((x[:, None, :] - entries) ** 2).sum(axis=2)
        assert (index == d.argmin(axis=1)).all() and (far == d.min(axis=1)).all()


def test_too_large_components_are_an_error(spark):
    with pytest.raises(Exception, match="64 bits"):
        vector_codes.compress_vectors(vector_table(spark, [(1, 1, [1e30] * 16)]))


# ---------------------------------------------------------------- token files

TEXTS = [None, "", "   \n", "one", "two words ##", "Ünï çødé 漢字 🙂", "a<|endoftext|>b<|endoftext|>", "a" * 70_000, "nul\0byte", "tab\tand\x0bvt\x85next"]


def documents(spark, texts, ids):
    return spark.createDataFrame([(i, t, b"x", "y") for i, t in zip(ids, texts)], "doc_id long, text string, ids binary, h string")


def test_ids_come_back(spark, tmp_path):
    rng = random.Random(3)
    texts = TEXTS + [" ".join(rng.choices(["the", "of", "Haus", "çé", "#", "12", "tion"], k=rng.randint(0, 3000))) for _ in range(60)]
    ids = rng.sample(range(-500, 500), len(texts))
    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode
    want, start = [], 0
    for i, t in sorted(zip(ids, texts), key=lambda x: x[0]):
        tokens = [*encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, start, np.array(tokens, "<u4").tobytes()))
        start += len(tokens)
    path = f"file://{tmp_path}/store"
    got = token_files.round_trip(documents(spark, texts, ids), path=path)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(map(tuple, got.collect())) == [(i, s, len(b) // 4, zlib.crc32(b)) for i, s, b in want]
    assert sorted((r.doc_id, r.start, bytes(r.ids)) for r in token_files.read(spark, path).collect()) == want
    # Any run of ids can be read from its checkpoint.
    manifest, codes = token_files.load(path)
    fs, folder = token_files.file_system(path)
    stream, base = np.frombuffer(b"".join(b for _, _, b in want), "<u4"), 0
    for s in manifest["shards"]:
        shard = token_files.Shard(fs, f"{folder}/{s['name']}", codes, manifest["block"])
        for _ in range(20):
            a = rng.randrange(s["ids"])
            b = rng.randint(a, s["ids"])
            assert (shard.read(a, b) == stream[base + a : base + b]).all()
        base += s["ids"]
    assert base == len(stream)
    assert not [f for f in fs.get_file_info(token_files_selector(folder)) if f.path.endswith(".body")]


def token_files_selector(folder):
    from pyarrow import fs

    return fs.FileSelector(folder)


def test_repeated_and_null_ids(spark):
    texts = ["b", "a", "a", None, "c", "a"] * 20
    got = token_files.round_trip(documents(spark, texts, [None, 1, 1, 1, 2, 2] * 20)).collect()
    ends = sorted((r.start, r.start + r.n_tokens) for r in got)
    assert len(got) == 120 and ends[0][0] == 0 and all(a[1] == b[0] for a, b in itertools.pairwise(ends))
    order = [(r.doc_id is not None, r.doc_id or 0) for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order)


def test_no_documents(spark):
    assert token_files.round_trip(documents(spark, ["x"], [1]).limit(0)).count() == 0


def test_code_lengths_are_optimal_within_the_limit():
    """Against plain Huffman where the limit doesn't bind, and all length choices where it does."""
    import heapq

    rng = np.random.default_rng(1)
    for _ in range(20):
        counts = rng.integers(1, 1000, rng.integers(2, 60))
        heap, total = counts.tolist(), 0
        heapq.heapify(heap)
        while len(heap) > 1:
            a = heapq.heappop(heap) + heapq.heappop(heap)
            total += a
            heapq.heappush(heap, a)
        assert int((token_files.code_lengths(counts, 40).astype(np.int64) * counts).sum()) == total
    for counts in ([1, 1, 2, 4, 8], [1, 100, 100, 1], [5, 1, 1, 1, 30, 2]):
        best = min(sum(c * n for c, n in zip(counts, ls)) for ls in itertools.product(range(1, 4), repeat=len(counts)) if sum(2.0**-x for x in ls) <= 1)
        got = token_files.code_lengths(np.array(counts), 3)
        assert got.max() <= 3 and int((got.astype(np.int64) * counts).sum()) == best


def test_writer_flushes_anywhere(tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "FLUSH", 100)
    monkeypatch.setattr(token_files, "SIDE", 3)
    rng = np.random.default_rng(2)
    docs = [rng.integers(0, 300, n).astype(np.uint32) for n in (0, 1, 99, 5000, 100, 0, 513, 512)]
    codes = token_files.Codes(token_files.code_lengths(np.bincount(np.concatenate(docs))))
    with open(tmp_path / "body", "wb") as out:
        writer = token_files.ShardWriter(out, codes)
        for k, d in enumerate(docs):
            writer.add(k, d)
        header, n = writer.close()
    body = (tmp_path / "body").read_bytes()
    (tmp_path / "shard").write_bytes(header + body[len(header) :])
    shard = token_files.Shard(token_files.file_system(str(tmp_path))[0], str(tmp_path / "shard"), codes)
    got = {}
    for d, _, ids, _ in shard.documents():
        got[d] = [*got.get(d, []), *ids.tolist()]
    assert n == sum(map(len, docs)) and [got[k] for k in range(len(docs))] == [d.tolist() for d in docs]


# ---------------------------------------------------------------- conversation repair

SPACE = " \t\n\v\f\r"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def repaired_by_force(rows):
    """The result for the rows of one conversation, by all audits that a table of best (cost, audit) needs."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()))
    turns = [r[1] for r in rows if r[1] is not None]
    res = {"gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
    seen, items = set(), []
    for _, _, role, text in rows:
        solid = text.strip(SPACE)
        fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            res[fault] += 1
        items.append((role, text, fault))
    res["illegal"] = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(items))
    # Forwards, from nothing: the best (cost, audit, turns) of each state; a longer audit of the same cost can't be the least later on only if compared whole, so all of one cost and state are kept.
    step = {"": {"s", "u"}, "s": {"u"}, "u": {"a"}, "a": {"u"}}
    frontier = {("", 0, "", ())}

    def insert(states):
        out = set(states)
        for _ in range(2):
            out |= {(t, c + 2, a + "I", m + (("user" if t == "u" else "assistant", ""),)) for s, c, a, m in out for t in step[s] - {"s"}}
        return out

    def thin(states):
        best = {}
        for s, c, a, m in states:
            best.setdefault(s, []).append((c, a, m))
        return {(s, *x) for s, all_ in best.items() for x in sorted(all_)[:6]}

    for role, text, fault in items:
        new = set()
        for s, c, a, m in insert(frontier):
            new.add((s, c + 3, a + "D", m))
            if fault in (None, "truncated"):
                cut = fault is not None
                if role[:1] in step[s]:
                    new.add((role[:1], c + cut, a + "K", m + ((role, text),)))
                for t in step[s] - {"s"}:
                    new.add((t, c + 2 + cut, a + "R", m + (("user" if t == "u" else "assistant", text),)))
        frontier = thin(new)
    cost, audit, turns = min((c, a, m) for s, c, a, m in insert(frontier) if s in ("", "a"))
    return res | {"cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest()}


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "x", 5) for r in rows], "conv_id long, turn long, role string, text string, sha string, copies int")


def check_repair(spark, rows):
    by = {r[0]: [] for r in rows}
    for r in damaged(rows):
        by[r[0]].append(r)
    got = {r.conv_id: r.asDict() for r in conversation_repair.damage_and_repair(conversations(spark, rows)).collect()}
    assert got == {k: {"conv_id": k} | repaired_by_force(v) for k, v in by.items()}


def random_rows(seed, n):
    rng = random.Random(seed)
    rows = []
    for conv in [None, *range(n)]:
        for k in range(rng.randint(1, 7)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "unicorn"])
            text = rng.choice(["yes.", "no!", "cut", "", " \t", None, "again?", "again?", "é ü.  ", f"text {k}.", "x\x85"])
            rows.append((conv, rng.choice([None, k, k, k, 0, 9]), role, text))
    return rows + rows[:9]


@pytest.mark.parametrize("block", [1, 2, 4096])
def test_repair_by_force(spark, monkeypatch, block):
    monkeypatch.setattr(conversation_repair, "BLOCK", block)
    check_repair(spark, random_rows(block, 150))


def test_one_conversation_of_many_ranges(spark):
    """A third of all rows in one conversation, a third equal rows."""
    rng = random.Random(8)
    rows = [(1, k, rng.choice(["user", "assistant", "system"]), f"text {rng.randrange(300)}{rng.choice('.?x')}") for k in range(400)]
    rows += [(2, 5, "user", "same.")] * 400 + [(k + 10, j, ["user", "assistant"][j % 2], f"text {k} {j}.") for k in range(100) for j in range(4)]
    check_repair(spark, rows)


def test_repair_of_nothing(spark):
    rows = [(k, 0, "user", "x.") for k in range(60)]  # some of which lose their only row
    assert any(zlib.crc32(f"{k}:0".encode()) % 20 == 0 for k in range(60))
    check_repair(spark, rows)
    assert conversation_repair.damage_and_repair(conversations(spark, rows).limit(0)).count() == 0


def test_repaired_turns(spark):
    rows = [(1, 0, "system", "be brief."), (1, 1, "assistant", "hello."), (2, 0, "user", "a."), (2, 1, "user", "b."), (2, 2, "assistant", "c.")]
    got = sorted((r.conv_id, r.role, r.text, r.edit) for r in conversation_repair.repair(conversations(spark, rows)).collect())
    assert got == [(1, "assistant", "hello.", "K"), (1, "system", "be brief.", "K"), (1, "user", "", "I"), (2, "assistant", "", "I"), (2, "assistant", "c.", "K"), (2, "user", "a.", "K"), (2, "user", "b.", "K")]


def test_distances_against_all_pairs_of_nodes():
    """Dial's distances against relaxing every arc until nothing changes."""
    rng = random.Random(9)
    for _ in range(50):
        codes = bytes(rng.choice([0, 1, 2, 3, 4, 5, 6, 8]) for _ in range(rng.randint(0, 8)))
        after = [rng.randrange(6) for _ in range(4)]
        n = len(codes)
        far = [10**6] * (4 * n) + list(after)
        for _ in range(4 * n + 8):
            for i, s in itertools.product(range(n + 1), range(4)):
                ways = [far[4 * i + s], far[4 * i + conversation_repair.TURN[s]] + 2]
                if i < n:
                    c, t = codes[i], conversation_repair.TURN[s]
                    ways.append(far[4 * i + 4 + s] + (0 if c == 8 else 3))
                    if c != 8:
                        cut = c >> 2
                        ways.append(far[4 * i + 4 + t] + cut + (0 if c & 3 == t else 2))
                        if s == 0 and c & 3 == 1:
                            ways.append(far[4 * i + 4 + 1] + cut)
                far[4 * i + s] = min(ways)
        assert conversation_repair.distances(codes, after) == far


def test_parameters_of_the_store(tmp_path, spark):
    path = f"file://{tmp_path}/s"
    token_files.write(spark.createDataFrame([(1, np.array([5, 5, 9], "<u4").tobytes())], "doc_id long, ids binary"), path)
    manifest = json.loads((tmp_path / "s" / "manifest.json").read_text())
    assert manifest["lengths"][5] == 1 and manifest["shards"][0]["ids"] == 3
