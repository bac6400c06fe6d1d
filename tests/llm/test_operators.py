"""Each operator against brute force, an exact round trip or held-out accuracy, and on odd tables."""

import collections
import hashlib
import io
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallymark.llm import attention, components, decontamination, jaccard_join, lm_scoring, mixing, nearest, suffix_dedup, token_counts, toxicity, url_filter, warc
from tallymark.llm.common import Rolling, file_system, hash_words, utf8, words

DOCS = "doc_id long, text string, source string, score string, kept string, leaks int, taken string"
ODD = [None, "", "   \n", "one", "two words", "Ünï çødé 漢字 🙂", "<|endoftext|>", "a" * 70_000, "nul\0byte", "tab\tand\x0bvt\x85next"]


def table(spark, texts, ids=None):
    """Documents with columns whose names clash with those that operators add."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, f"s{k % 3}" if k % 4 else None, "x", "y", 1, "z") for k, (i, t) in enumerate(zip(ids, texts))], DOCS)


def prose(rng, n):
    return " ".join("".join(rng.choices(["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha"], k=rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    return table(spark, ODD + ODD[:6], [*range(len(ODD)), None, None, 0, 1, 2, 3]).cache()


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


# ---------------------------------------------------------------- shared pieces


def test_words_and_hashes():
    texts = ["a bc", "", " \t", "bc", "d", "bc\x0ba"]
    import pyarrow as pa

    raw, at = utf8(pa.array([*texts, None]))
    start, end, first = words(raw, at)
    assert [bytes(raw[a:b]).decode() for a, b in zip(start, end)] == ["a", "bc", "bc", "d", "bc", "a"]
    assert list(np.diff(first)) == [2, 0, 0, 1, 1, 2, 0]
    h = Rolling(raw).spans(start, end)
    assert h[1] == h[2] == h[4] and h[0] == h[5] and len(set(h.tolist())) == 3


def test_words_that_polynomials_take_for_one():
    """A word of Thue and Morse's and its complement: alike under every polynomial modulo 2 ** 64."""
    word = "a"
    for _ in range(11):
        word += word.translate(str.maketrans("ab", "ba"))
    raw = np.frombuffer(f"{word} {word.translate(str.maketrans('ab', 'ba'))} {word}".encode(), np.uint8)
    at = np.array([0, len(raw)])
    start, end, _ = words(raw, at)
    plain = Rolling(raw).spans(start, end)
    assert plain[0] == plain[1]
    h = hash_words(raw, start, end, 1)
    assert h[0] == h[2] != h[1]
    assert lm_scoring.Numbers().look(raw, at)[0].tolist() in ([0, 1, 0], [1, 0, 1])


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (100, 102), (7, 7), (200, 201), (201, 200)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[102] == 100 and got[201] == 200
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


# ---------------------------------------------------------------- 1


def a_table(seed=2):
    rng = np.random.default_rng(seed)
    return attention.Table(rng.poisson(0.2, (attention.SLOTS, attention.SLOTS)) * rng.integers(1, 50, attention.SLOTS))


def test_gradient_is_right():
    rng = np.random.default_rng(0)
    flat, table = attention.initial().astype(np.float64), a_table()
    x, y = (rng.integers(0, attention.SLOTS, (3, attention.CONTEXT)) for _ in range(2))
    x[0, : attention.HALF], y[0, : attention.HALF - 1] = -1, -1
    g = np.zeros_like(flat)
    attention.gradient(attention.unpack(flat), table, x, y, attention.unpack(g))
    at, places = 0, []
    for shape in attention.SHAPES.values():
        size = int(np.prod(shape))
        places += (at + rng.choice(size, min(size, 12), replace=False)).tolist()
        at += size
    used = attention.unpack(np.arange(len(flat)))["e"][x[1]].ravel()
    for i in [*places, *rng.choice(used, 20)]:
        loss = []
        for d in (1e-4, -1e-4):
            f = flat.copy()
            f[i] += d
            loss.append(attention.gradient(attention.unpack(f), table, x, y, attention.unpack(np.zeros_like(f))))
        assert abs((loss[0] - loss[1]) / 2e-4 - g[i]) < 1e-4


def test_tables_are_the_shares_of_neighbours():
    pairs = np.random.default_rng(1).poisson(0.1, (attention.SLOTS, attention.SLOTS))
    table = attention.Table(pairs)
    chance = np.exp(table.kind[:, :, None] + table.member.astype(float)).reshape(attention.SLOTS, -1)
    assert chance.sum(axis=1) == pytest.approx(np.ones(attention.SLOTS), abs=1e-4)
    share = (pairs.sum(axis=0) + 0.5) / (pairs.sum(axis=0) + 0.5).sum()
    for i, j in ((3, 7), *np.argwhere(pairs > 1)[:5]):
        smooth = 1 + (pairs[i] > 0).sum()
        assert chance[i, j] == pytest.approx((pairs[i, j] + smooth * share[j]) / (pairs[i].sum() + smooth), rel=1e-3)
        less = np.exp(table.kind_less[i, j] + float(table.member_less[i, j]))
        assert less == pytest.approx((max(pairs[i, j] - 1, 0) + smooth * share[j]) / (pairs[i].sum() + smooth), rel=1e-3)


def test_windows_score_each_token_once_as_training_has_it():
    rng = np.random.default_rng(1)
    flat, table = attention.initial(), a_table()
    table.kind_less, table.member_less = (np.take_along_axis(t, i, axis=1) for t, i in ((table.kind, np.arange(attention.SLOTS)[None] // attention.MEMBERS), (table.member.reshape(attention.SLOTS, -1), np.arange(attention.SLOTS)[None])))
    tokens, at = rng.integers(0, attention.SLOTS, 75), np.array([0, 40, 40, 75])
    got, half = attention.Scorer(flat, table).score(tokens, at), attention.HALF
    for a, b in ((0, 40), (40, 75)):
        before = np.concatenate(([attention.BEGIN], tokens[a : b - 1]))
        for k in range(0, b - a, half):
            x, y = (np.full((1, attention.CONTEXT), -1) for _ in range(2))
            if k:
                x[0, :half] = before[k - half : k]
            n = min(half, b - a - k)
            x[0, half : half + n], y[0, half : half + n] = before[k : k + n], tokens[a + k : a + k + n]
            loss = attention.gradient(attention.unpack(flat), table, x, y, attention.unpack(np.zeros_like(flat)))
            assert got[a + k : a + k + n].sum() == pytest.approx(-loss * n, rel=1e-4)


def test_probabilities_sum_to_one():
    s = attention.Scorer(attention.initial(), a_table())
    every = np.arange(attention.SLOTS)
    tokens = np.stack([np.full_like(every, 5), every], axis=1).ravel()
    lp = s.score(tokens, np.arange(0, len(tokens) + 1, 2))[1::2]
    assert np.exp(lp.astype(float)).sum() == pytest.approx(1, abs=1e-3)


def base_score(texts, held):
    w = [[*(t or "").encode().lower().split(), None] for t in texts]
    c = collections.Counter(x for own, h in zip(w, held) if not h for x in own)
    n, v = sum(c.values()), len(c)
    return n, [(len(own), sum(c[x] > 0 for x in own), sum(math.log10((c[x] + 1) / (n + v + 1)) for x in own)) for own in w]


def test_lm_base_score_and_learning(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "HEAVY", 200)  # so that some words are joined
    rng = random.Random(5)
    texts = [*ODD, *(prose(rng, rng.randint(1, 200)) for _ in range(300))]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    got = lm_scoring.score_texts(table(spark, texts)).orderBy("doc_id").collect()
    n, want = base_score(texts, held)
    assert [r.held_out for r in got] == held and {r.train_tokens for r in got} == {n}
    assert [(r.n_tokens, r.n_known) for r in got] == [w[:2] for w in want]
    assert [r.base_score for r in got] == pytest.approx([w[2] for w in want])
    monkeypatch.setattr(lm_scoring, "ROUNDS", 0)
    out = [i for i, h in enumerate(held) if h and i >= len(ODD)]
    tables = lm_scoring.score_texts(table(spark, texts)).orderBy("doc_id").collect()  # the model before training: counts of neighbours alone
    assert sum(got[i].score for i in out) > sum(tables[i].score for i in out)
    pairs = lm_scoring.count_pairs
    monkeypatch.setattr(lm_scoring, "count_pairs", lambda *a: (lambda p: np.outer(p.sum(axis=1), p.sum(axis=0) / p.sum()))(pairs(*a)))
    counts = lm_scoring.score_texts(table(spark, texts)).orderBy("doc_id").collect()  # counts of subwords alone
    assert sum(got[i].score for i in out) > 0.95 * sum(counts[i].score for i in out)


def test_model_is_better_than_counts_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = lm_scoring.score_texts(docs).filter("held_out").agg(F.sum("score").alias("score"), F.sum("base_score").alias("base"), F.sum("n_tokens").alias("n")).first()
    assert got.score > got.base and got.score / got.n > -4.06


def test_lm_sees_every_token(spark):
    """Neighbours are counted over all texts; the pieces of a small corpus hold every token once, those of a large one an even part."""
    import pyarrow as pa

    rng = random.Random(6)
    texts = [*ODD, *(prose(rng, n) for n in (1, 63, 64, 65, 513, 1300, 5000))]
    docs = table(spark, texts).select(F.coalesce("text", F.lit("")).alias("text"), (F.col("doc_id") == 4).alias("held_out"))
    path = public_tokenizers.path(lm_scoring.VOCABULARY)
    counts, pieces = lm_scoring.count_words(docs, 1, path)
    ids = lm_scoring.count_subwords(counts, path)
    vocabulary, ends = lm_scoring.Vocabulary(ids), len(texts) - 1
    rows = pieces.collect()
    x, y = lm_scoring.windows_of(pa.array([bytes(r.piece) for r in rows], pa.binary()), [r.edge for r in rows], lm_scoring.Lexicon(vocabulary, None, path))
    want = np.bincount(vocabulary.slot, ids, attention.SLOTS)
    want[attention.BEGIN] += ends
    assert np.bincount(y[y >= 0], minlength=attention.SLOTS).tolist() == want.tolist()
    pairs = lm_scoring.count_pairs(counts, vocabulary.slot, ends)
    assert pairs.sum(axis=0) == pytest.approx(want, rel=1e-4) and pairs.sum(axis=1) == pytest.approx(want, rel=1e-4)
    code = lm_scoring.encoder(path).encode_ordinary
    inner, first, last = collections.Counter(), np.zeros(attention.SLOTS), np.zeros(attention.SLOTS)
    for k, t in enumerate(texts):
        for w in (t or "").encode().lower().split() if k != 4 else []:
            z = vocabulary.slot[code(" " + w.decode())].tolist()
            inner.update(zip(z, z[1:]))
            first[z[0]], last[z[-1]] = first[z[0]] + 1, last[z[-1]] + 1
    first[attention.BEGIN] = last[attention.BEGIN] = ends
    full = np.outer(last, first / first.sum())
    for (i, j), n in inner.items():
        full[i, j] += n
    assert pairs == pytest.approx(full, rel=1e-4, abs=1e-4)
    some = lm_scoring.count_words(table(spark, [prose(rng, 700) for _ in range(300)]).select("text", F.lit(False).alias("held_out")), 8, path)[1].collect()
    places = collections.Counter(r.edge for r in some)
    assert len(some) == pytest.approx(300 * 11 / 8, rel=0.1) and places[1] == pytest.approx(300 / 8, rel=0.5) and places[2] == pytest.approx(300 / 8, rel=0.5)


def test_lexicon_knows_words_again(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(lm_scoring, "REMEMBERED", 500)
    path = public_tokenizers.path(lm_scoring.VOCABULARY)
    counts = np.zeros(lm_scoring.encoder(path).n_vocab)
    counts[:3000] = 5
    lexicon, rng = lm_scoring.Lexicon(lm_scoring.Vocabulary(counts), None, path), random.Random(3)
    for _ in range(30):
        texts = [*ODD, *(prose(rng, rng.randint(0, 60)).title() for _ in range(20)), "\u2003x y\u00a0z \u0085"]
        lexicon.bound()
        w, _, _, first = lexicon.look(*utf8(pa.array(texts, pa.string())))
        want = [(t or "").encode().lower().split() for t in texts]
        assert np.diff(first).tolist() == [len(x) for x in want]
        assert [lexicon.words[k] for k in w.tolist()] == [x for own in want for x in own]
        slots, at = lexicon.tokens(w)
        for k, x in enumerate(x for own in want for x in own):
            ids = lm_scoring.encoder(path).encode_ordinary(" " + x.decode())
            assert slots[at[k] : at[k + 1]].tolist() == lexicon.vocabulary.slot[ids].tolist()


def test_frequent_words_are_confirmed(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(lm_scoring.xxhash, "xxh64_intdigest", len)
    heavy = lm_scoring.Heavy(pa.array([b"aa", b"bb", b"c"], pa.binary()), np.array([1.0, 2.0, 3.0]))
    assert heavy.of([b"bb", b"zz", b"c", b"aa", b"", b"dddd"]).tolist() == [2, -1, 3, 1, -1, -1]


def test_lm_odd_tables(spark, odd, empty):
    assert lm_scoring.score_texts(empty).count() == 0
    got = lm_scoring.score_texts(odd).collect()
    assert len(got) == odd.count() and all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert {r.n_tokens for r in got if r.doc_id == 2} == {1, 3}


# ---------------------------------------------------------------- 2


def test_token_counts_are_the_library_s(spark, odd, empty):
    rng = random.Random(2)
    texts = [*ODD, "don't I'LL we've  \n\n x <|endoftext|>y<|endoftext|>", "<|endoftext", f"{prose(rng, 250_000)}  ünd {prose(rng, 10)}", *("".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xD000), rng.randrange(0x1F300, 0x1F600)])) for _ in range(60)) for _ in range(200))]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts]
    got = token_counts.count_tokens(table(spark, texts)).orderBy("doc_id").collect()
    assert [r.n_tokens for r in got] == want
    assert [r.n_bytes for r in got] == [len((t or "").encode()) for t in texts]
    assert [r.over_limit for r in got] == [n > 512 for n in want]
    assert token_counts.count_tokens(empty).count() == 0 and token_counts.count_tokens(odd).count() == odd.count()


def test_whole_tokens_are_proved():
    rules = token_counts.Rules(public_tokenizers.path("byte_bpe_50k.json"))
    library = Tokenizer.from_file(rules.path)
    some = random.Random(1).sample(sorted(rules.whole), 500)
    counter = token_counts.Counter(rules)
    for piece in some:
        if counter.cut.findall(piece) == [piece]:
            assert len(library.encode(piece, add_special_tokens=False).ids) == 1


# ---------------------------------------------------------------- 3

PAGES = [(3, "http://a/ b", "x" * 100), (1, "u", "x" * 100), (2, None, "x" * 99), (5, "u", "x" * 99), (4, "u", None), (None, "u", "x" * 100), (1, "u", "x" * 100), (7, "v", "é" * 60), (6, "v\r\nEvil: 1", "é" * 60), (8, "v", "\0\r\n\r\nWARC/1.1"), (None, "v", "z" * 200)]


def test_warc_round_trip(spark):
    pages = spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, payload string")
    digest = lambda h: hashlib.sha256((h or "").encode()).hexdigest()
    want = []
    for page, _, html in PAGES:
        same = [p for p, _, h in PAGES if h == html and p is not None]
        first = min(same) if same and len((html or "").encode()) >= 100 else page
        want.append((page, len((html or "").encode()), digest(html), "response" if page == first else "revisit", None if page == first else first))
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, warc.round_trip(pages).collect()), key=key) == sorted(want, key=key)
    back = warc.read_warc(warc.write_warc(pages)).filter("record_type = 'response'").collect()
    assert {(r.page_id, bytes(r.payload).decode()) for r in back} == {(p, h or "") for (p, _, h), w in zip(PAGES, want) if w[3] == "response"}
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_reader_notices_damage():
    good = warc.encode_record(1, "u", b"hello" * 50, 250, hashlib.sha256(b"hello" * 50).hexdigest(), None)
    assert len(list(warc.read_records(io.BytesIO(good + good)))) == 2
    for bad in (good[:-3], good + good[:40], zlib.compress(b"x"), good + b"junk"):
        with pytest.raises(warc.WarcError):
            list(warc.read_records(io.BytesIO(bad)))
    other = warc.encode_record(1, "u", b"hello" * 50, 250, "0" * 64, None)
    with pytest.raises(warc.WarcError):
        [warc.split_http(*r) for r in warc.read_records(io.BytesIO(other))]


# ---------------------------------------------------------------- 4


def removed(rows, length=50):
    first, cover = {}, {}
    for _, (i, t) in sorted(enumerate(rows), key=lambda r: (r[1][0] is None, r[1][0] or 0)):
        b = (t or "").encode()
        for k in range(len(b) - length + 1):
            first.setdefault(b[k : k + length], i)
    out = []
    for i, t in rows:
        b, gone = (t or "").encode(), bytearray(len((t or "").encode()))
        for k in range(len(b) - length + 1):
            f = first[b[k : k + length]]
            if f is not None and (i is None or f < i):
                gone[k : k + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone) if not g)
        n = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), n, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("crowded", [False, True])
def test_repeats_are_removed_as_by_brute_force(spark, monkeypatch, crowded):
    if crowded:  # every repeated anchor is dealt out window by window
        real = suffix_dedup._repeated
        monkeypatch.setattr(suffix_dedup, "_repeated", lambda entries, crowd, buckets: real(entries, 0, buckets))
    rng = random.Random(4)
    passages = [prose(rng, n) for n in (5, 9, 12, 20, 60)] + ["é" * 40, "ab" * 60]
    texts = [" ".join(rng.choice([rng.choice(passages), prose(rng, 8), rng.choice(passages)[rng.randint(0, 9) :]]) for _ in range(rng.randint(1, 5))) for _ in range(60)]
    texts += [None, "", "short", passages[4], passages[4], texts[0], texts[1] + "!", "a" * 300, "b" + "a" * 200]
    ids = [*range(len(texts) - 3), None, 5, 5]
    rng.shuffle(ids)
    rows = list(zip(ids, texts))
    got = suffix_dedup.remove_repeats(table(spark, texts, ids).repartition(3)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(removed(rows), key=key)


def test_longest_previous_factors():
    raw = np.frombuffer(b"abcab|abcxx|bcabc|", np.uint8)
    starts, doc = np.array([0, 1, 6, 7, 12]), np.array([0, 0, 1, 1, 2])
    assert suffix_dedup.longest_previous(raw, starts, doc, 3).tolist() == [0, 0, 3, 2, 3]
    rng = np.random.default_rng(0)
    doc, gap = rng.integers(0, 9, 200), rng.integers(0, 50, 200)
    to, least = suffix_dedup.nearest_smaller(doc, gap)
    for i in range(200):
        j = next((j for j in range(i - 1, -1, -1) if doc[j] < doc[i]), -1)
        assert to[i] == j and least[i] == (gap[j + 1 : i + 1].min() if j >= 0 else 0)


def test_dedup_odd_tables(spark, odd, empty):
    assert suffix_dedup.remove_repeats(empty).count() == 0
    got = suffix_dedup.remove_repeats(odd)
    assert got.count() == odd.count() and got.filter("length(kept) + n_removed <> n_bytes").count() == 0


# ---------------------------------------------------------------- 5


def test_toxicity_on_held_out_texts(spark):
    rng = random.Random(6)
    texts, marks = [], []
    for _ in range(600):
        t = prose(rng, rng.randint(20, 120)).split()
        marks.append(int(rng.random() < 0.25))
        for _ in range(2 * marks[-1]):
            t.insert(rng.randrange(len(t)), rng.choice(["grumbles", "Wretched!", "foulmouth"]))
        texts.append(" ".join(t))
    labels = spark.createDataFrame([*enumerate(marks), (0, None), (None, 1), (10**9, 1)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(table(spark, texts), labels).collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i in range(600) if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([r.predicted == marks[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)


def test_characters_are_code_points():
    import pyarrow as pa

    raw, at = utf8(pa.array(["Été\t🙂x", "", "été\u2003🙂X", None, "ab"]))
    code, ends = toxicity.characters(raw, at)
    assert ends.tolist() == [0, 6, 6, 12, 12, 14] and code[:6].tolist() == code[6:12].tolist()
    assert len(set(code[:6].tolist())) == 5 and not set(code[:6].tolist()) & set(code[12:].tolist())


def test_classifier_is_that_of_brute_force(spark, monkeypatch):
    """Log-count ratios, kept features and the scores' order against plain Python over n-grams of characters."""
    rng = random.Random(11)
    texts, marks = [], []
    for _ in range(160):
        t = prose(rng, rng.randint(5, 30)).split()
        marks.append(int(rng.random() < 0.4))
        if marks[-1]:
            t.insert(rng.randrange(len(t)), "Grümßlig")
        texts.append(" ".join(t))
    labels = spark.createDataFrame([*enumerate(marks)], "doc_id long, toxic int")
    docs = table(spark, texts)
    model = toxicity.train(docs, labels)

    def grams(t):
        low = "".join(" " if c.isspace() else c.lower() for c in t)
        return {low[i : i + n] for n in toxicity.SIZES for i in range(len(low) - n + 1)}

    own = [i for i in range(160) if zlib.crc32(str(i).encode()) % 4 != 2]
    pos, neg = (collections.Counter(g for i in own if marks[i] == k for g in grams(texts[i])) for k in (1, 0))
    n_pos, n_neg = sum(marks[i] for i in own), sum(1 - marks[i] for i in own)
    kept = {}
    for g in set(pos) | set(neg):
        p, q, both = (pos[g] + 1) / (n_pos + 2), (neg[g] + 1) / (n_neg + 2), (pos[g] + neg[g] + 1) / (n_pos + n_neg + 2)
        z = (p - q) / math.sqrt(both * (1 - both) * (1 / (n_pos + 1) + 1 / (n_neg + 1)))
        if pos[g] + neg[g] >= toxicity.LEAST and abs(z) >= toxicity.BEYOND and abs(math.log(p / q)) >= toxicity.EFFECT:
            kept[g] = math.log(p / q)
    assert len(kept) >= 5 and (model.slots >= 0).sum() == len(kept)
    # Plain gradient descent over the same features reaches the same scores.
    x = np.array([[r if g in grams(t) else 0.0 for g, r in sorted(kept.items())] for t in texts])
    y, w, b = np.array(marks)[own], np.zeros(len(kept)), 0.0
    for _ in range(20_000):
        off = 1 / (1 + np.exp(-(x[own] @ w + b))) - y
        w, b = w - 0.1 * (x[own].T @ off + w) / len(own), b - 0.1 * off.mean()
    want = 1 / (1 + np.exp(-(x @ w + b)))
    got = {r.doc_id: r.score for r in toxicity.score(docs, model, name="score").collect()}
    assert [got[i] for i in range(160)] == pytest.approx(want.tolist(), abs=0.02)


def test_a_repeated_id_does_not_grow_the_sample(spark, monkeypatch):
    seen, real = [], toxicity._counts
    monkeypatch.setattr(toxicity, "_counts", lambda sample: seen.append(sample.count()) or real(sample))
    docs = table(spark, [f"text {k}" for k in range(50)], [1] * 40 + list(range(2, 12)))
    toxicity.train(docs, spark.createDataFrame([(k, k % 2) for k in range(12)] + [(1, 1)], "doc_id long, toxic int"), train_rows=5)
    assert seen[0] <= 5


def test_toxicity_odd_tables(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score_toxicity(empty, none).count() == 0
    assert toxicity.score_toxicity(odd, none).filter("score IS NULL OR predicted = 1").count() == 0
    one = spark.createDataFrame([(3, 1)], "doc_id long, toxic int")
    assert toxicity.score_toxicity(odd, one).count() == odd.count()


# ---------------------------------------------------------------- 6


def shares(sizes, weights, budget):
    """By resharing the excess until none is left."""
    target, free, left = {}, dict(zip(sizes, weights)), budget
    while free:
        w = sum(free.values())
        over = [s for s in free if free[s] * left / w > 2 * sizes[s]]
        if not over:
            return target | {s: free[s] * left / w for s in free}
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            del free[s]
    return target


@pytest.mark.parametrize("bits", [2, 12])
def test_mix_meets_its_targets(spark, bits):
    rng = random.Random(7)
    rows = [(i, prose(rng, rng.randint(0, 90)), "bac"[min(2, int(rng.expovariate(2)))] if i % 9 else None) for i in range(400)]
    rows += [(5, "same words", "a"), (5, "same words", "a"), (None, "x y", "d"), (None, None, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    got = mixing.mix_sources(docs, bits=bits).collect()
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    order = sorted((s for s in sizes if s is not None)) + [None]
    want = shares({s: sizes[s] for s in order}, [(3, 1, 2)[k % 3] for k in range(len(order))], 1.5 * sum(sizes.values()))
    assert len(got) == len(rows) and all(0 <= r.taken <= 2 * r.size for r in got)
    taken = collections.Counter()
    by_target = {round(t, 6): s for s, t in want.items()}
    for r in got:
        taken[by_target[round(r.target, 6)]] += r.taken
    assert all(abs(taken[s] - want[s]) <= len(want) for s in want) and sum(taken.values()) == int(1.5 * sum(sizes.values()))
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix_sources(docs.repartition(5), bits=bits).collect()))


def test_stream_keeps_shares_all_along(spark):
    docs = spark.createDataFrame([(i, "w " * 20, "ab"[i % 4 == 0]) for i in range(400)], "doc_id long, text string, source string")
    units = [r for r in mixing.schedule(docs).collect() if r.words]
    assert len({r.place for r in units}) == len(units)
    served, target = collections.Counter(), {}
    for r in sorted(units, key=lambda r: r.place):
        served[r.key] += r.words
        target[r.key] = r.target
        at = [served[k] / target[k] for k in target]
        assert len(at) < 2 or abs(at[0] - at[1]) < 0.02


def test_the_budget_is_the_only_cut(spark):
    """All of the stream up to the budget is taken and nothing behind it, in the order of finish times; only the packet at the end is cut."""
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, "w " * int(rng.paretovariate(0.9) * 4), "abc"[i % 7 % 3]) for i in range(300)], "doc_id long, text string, source string")
    units = sorted(mixing.schedule(docs).collect(), key=lambda r: r.place)
    budget = int(1.5 * docs.select(F.regexp_count("text", F.lit("w"))).agg(F.sum(F.col("regexp_count(text, w)"))).first()[0])
    full = [r for r in units if r.finish is not None]
    assert [r.finish for r in full] == sorted(r.finish for r in full)
    assert sum(r.words for r in units) == budget and all(r.words == 0 for r in full if r.place >= budget)
    ends = [n for r, n in zip(full, full[1:])]
    cut = [r for r, n in zip(full, ends) if r.place < budget and r.words != n.place - r.place]
    assert len(cut) <= 1 and max(r.finish for r in full if r.words) < 1.5
    # Served source after source instead, the same budget would leave the last source without its share.
    served = collections.Counter()
    for r in units:
        served[r.key] += r.words
    target = {r.key: r.target for r in units}
    assert all(abs(served[k] - target[k]) <= len(target) for k in target)


def test_mix_odd_tables(spark, odd, empty):
    assert mixing.mix_sources(empty).count() == 0 and mixing.mix_documents(empty).count() == 0
    assert mixing.mix_sources(odd).count() == odd.count()
    assert mixing.mix_documents(odd).agg(F.sum("taken")).first()[0] == mixing.mix_sources(odd).agg(F.sum("taken")).first()[0]


# ---------------------------------------------------------------- 7


def test_leaks_and_paraphrases_are_found(spark):
    rng = random.Random(8)
    items = [prose(rng, n) for n in (24, 30, 40, 55, 120, 4)]
    texts, want = [prose(rng, rng.randint(1, 400)) for _ in range(300)], set()
    for i, item in enumerate(items[:5]):
        for _ in range(6):
            texts.append(f"{prose(rng, rng.randint(0, 60))} {item.upper()}. {prose(rng, rng.randint(0, 60))}")
            want.add((len(texts) - 1, i))
        w = item.split()
        for k in rng.sample(range(len(w)), len(w) // 8):
            w[k] = prose(rng, 1)
        texts.append(f"{prose(rng, 30)} {' '.join(w)} {prose(rng, 30)}")
        want.add((len(texts) - 1, i))
    bench = spark.createDataFrame([*enumerate(items), (6, None), (7, ""), (None, texts[0])], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.leaked_pairs(table(spark, texts), bench).collect()}
    assert want <= got and all(i >= 300 or j == 5 for i, j in got)
    monkey = decontamination.ITEMS
    try:
        decontamination.ITEMS = 2
        parts = {(r.doc_id, r.item_id) for r in decontamination.leaked_pairs(table(spark, texts), bench).collect()}
    finally:
        decontamination.ITEMS = monkey
    assert parts == got


def test_leaks_are_found_with_a_latent_space_of_a_sample(spark, monkeypatch):
    """Exact passages and such with a fifth of their words exchanged, where 1 block in 5 is fitted on."""
    rng = random.Random(9)
    items = [prose(rng, rng.randint(20, 60)) for _ in range(60)]
    bench = spark.createDataFrame([*enumerate(items)], "item_id long, text string")
    texts = [prose(rng, 200) for _ in range(300)]
    for item in items:
        for rate in (0, 0.2):
            w = [prose(rng, 1) if rng.random() < rate else x for x in item.split()]
            texts.append(f"{prose(rng, 40)} {' '.join(w)} {prose(rng, 40)}")
    docs = table(spark, texts)
    monkeypatch.setattr(decontamination, "SAMPLE", 1000)
    df, total = decontamination.frequencies(docs.select("text"))
    assert total > 4000
    got = {(r.doc_id, r.item_id) for r in decontamination.leaked_pairs(docs, bench).collect()}
    assert all(a >= 300 and (a - 300) // 2 == i for a, i in got)
    assert {(300 + 2 * i, i) for i in range(60)} <= got and len(got) >= 60 + 54


def test_blocks_of_the_sample():
    n = [len(decontamination.chosen(k, 1000, 3, 10_000_000)) for k in range(0, 200_000, 1000)]
    assert sum(n) == pytest.approx(200_000 * decontamination.SAMPLE / 1e7, rel=0.05)
    assert len(decontamination.chosen(5, 70, 0, 70)) == 70


def subsequence(a, b):
    d = [0] * (len(b) + 1)
    for x in a:
        old, d = d, [0]
        for j, y in enumerate(b):
            d.append(old[j] + 1 if x == y else max(old[j + 1], d[j]))
    return d[-1]


def hashed(texts):
    import pyarrow as pa

    h, first = decontamination.word_hashes(*utf8(pa.array(texts, pa.string())))
    return [h[a:b].tolist() for a, b in zip(first, first[1:])]


def test_word_check_is_that_of_brute_force(monkeypatch):
    monkeypatch.setattr(decontamination, "REGIONS", 500)
    rng = random.Random(9)
    say = lambda n: " ".join(rng.choice("abcdefghij") + rng.choice("xyz") for _ in range(n))
    texts = [*(say(n) for n in (1, 5, 9, 30, 63, 64, 65, 128, 129, 200)), "", None]
    answers = [None, "ax", "ax by", *[None] * 6, "words that nobody has", "ax", None]
    df = np.arange(1 << decontamination.BITS)
    items = decontamination.Items(list(range(len(texts))), texts, answers, df, np.zeros((1 << decontamination.BITS, 4), np.float32))
    h = np.concatenate([np.array(x, np.uint64) for x in hashed([say(700), texts[7], say(80), texts[9]])])
    item = np.array([rng.randrange(10) for _ in range(200)])
    low = np.array([rng.randrange(len(h)) for _ in item])
    high = np.array([rng.randint(a, len(h)) for a in low])
    share, leak = items.check(h, item, low, high)
    own, told = hashed([t or "" for t in texts]), hashed([a or "" for a in answers])
    for i, a, b, s, found in zip(item, low, high, share, leak):
        region, words = h[a:b].tolist(), own[i]
        want = subsequence(words, region)
        assert s == want / len(words) or s == 0 and want / len(words) < decontamination.LIKELY
        rare = sorted(set(words), key=lambda x: (df[x >> 64 - decontamination.BITS], x))
        answer = set(told[i]) or set(rare[: -(-len(rare) // 4)])
        ok = want / len(words) >= decontamination.SURE or want / len(words) >= decontamination.LIKELY and len(answer & set(region)) / len(answer) >= decontamination.ANSWER
        assert found == (want == len(words) if len(words) < decontamination.SHORT else ok)


def test_search_is_that_of_brute_force():
    """Every passage against every item by cosine; each region word by word."""
    import pyarrow as pa

    rng = random.Random(4)
    benchmark = [prose(rng, n) for n in (20, 33, 40, 70, 140)]
    texts = [prose(rng, rng.randint(1, 300)) for _ in range(40)]
    for k in range(0, 40, 2):
        w = rng.choice(benchmark).split()
        texts[k] += " " + " ".join(x for x in w if rng.random() > 0.3) + " " + prose(rng, 50)
    weights = np.random.default_rng(1).standard_normal((1 << decontamination.BITS, 24)).astype(np.float32)
    df = np.ones(1 << decontamination.BITS)
    items = decontamination.Items(list(range(5)), benchmark, [None] * 5, df, weights)
    h, first = decontamination.word_hashes(*utf8(pa.array(texts)))
    got = {(t, i): (s, c) for t, i, s, c in zip(*(x.tolist() for x in items.search(h, first, weights)))}

    def unit(words):
        v = sum(weights[x >> 64 - decontamination.BITS] for x in words).astype(float)
        return v / np.linalg.norm(v)

    def cut(words):
        n = decontamination.BLOCK
        return [(k, min(k + 2 * n, len(words))) for k in range(0, max(len(words) - n, 1), n)]

    want, own = {}, hashed(benchmark)
    for t, words in enumerate(hashed(texts)):
        for i, item in enumerate(own):
            parts = collections.defaultdict(list)
            for a, b in cut(words):
                c = max(unit(words[a:b]) @ unit(item[x:y]) for x, y in cut(item))
                assert abs(c - decontamination.COSINE) > 1e-6
                if c >= decontamination.COSINE:
                    parts[a // (len(item) // 2)].append((a, b, c))
            for some in parts.values():
                region = words[max(0, min(x[0] for x in some) - len(item)) : max(x[1] for x in some) + len(item)]
                share = subsequence(item, region) / len(item)
                rare = sorted(set(item), key=lambda x: (df[x >> 64 - decontamination.BITS], x))
                rare = set(rare[: -(-len(rare) // 4)])
                if share >= decontamination.SURE or share >= decontamination.LIKELY and len(rare & set(region)) / len(rare) >= decontamination.ANSWER:
                    want[t, i] = max(want.get((t, i), (0, 0)), (share, max(x[2] for x in some)))
    assert got.keys() == want.keys() and len(want) >= 15
    assert all(got[k] == pytest.approx(want[k], abs=1e-5) for k in want)


def test_answers_decide_between_shares(spark):
    """At a share between LIKELY and SURE a leak needs the item's answer."""
    rng = random.Random(10)
    item = prose(rng, 40).split()
    half = " ".join(x if k % 20 < 11 else prose(rng, 1) for k, x in enumerate(item))
    share = subsequence(*hashed([" ".join(item), half])) / 40
    assert decontamination.LIKELY <= share < decontamination.SURE
    texts = [*(prose(rng, 200) for _ in range(100)), half, f"{half} forty two"]
    bench = spark.createDataFrame([(0, " ".join(item), "forty two")], "item_id long, text string, answer string")
    found = decontamination.leaked_pairs(table(spark, texts), bench, item_answer="answer").collect()
    assert [r.doc_id for r in found] == [101]


def test_leaks_odd_tables(spark, odd, empty):
    bench = spark.createDataFrame([(1, "some item that nobody has at all")], "item_id long, text string")
    assert decontamination.find_leaks(empty, bench).count() == 0
    assert decontamination.find_leaks(odd, bench).filter(F.size("leaks") > 0).count() == 0
    assert decontamination.leaked_pairs(odd, bench.limit(0)).count() == 0
    clash = odd.withColumns({c: F.lit(1) for c in ("found", "__text", "leaks", "item_id")})
    assert decontamination.find_leaks(clash, bench).columns == [*(c for c in clash.columns if c != "leaks"), "leaks"]
    long = table(spark, ["wörd " * 400_000 + bench.first().text])
    assert [r.item_id for r in decontamination.leaked_pairs(long, bench).collect()] == [1]


# ---------------------------------------------------------------- 8


def test_urls(spark):
    urls = {
        "http://A.Example.ORG/x": ("a.example.org", "/x", "org/", "allow"), "https://www.example.org/es/1?q#f": ("www.example.org", "/es/1", "example.org/es/", "block"), "x://example.org/en/19": ("example.org", "/en/19", "example.org/en/1", "block"),
        "x://example.org": ("example.org", "", None, "allow"), "x://spam-farm.example.org": ("spam-farm.example.org", "", None, "block"), "x://spam-farm.example.org/": ("spam-farm.example.org", "/", "org/", "allow"),
        "x://notexample.com/de/": ("notexample.com", "/de/", "com/de/", "block"), "x://m.ads-track.example.com/fr/a": ("m.ads-track.example.com", "/fr/a", "com/fr/", "allow"), "x://m.ads-track.example.com/en": ("m.ads-track.example.com", "/en", None, "block"),
        "no scheme": ("", "", None, "allow"), None: ("", "", None, "allow"), "://": ("", "", None, "allow"), "x://h?a/b": ("h", "", None, "allow"), "x://É.org/": ("É.org", "/", "org/", "allow"),
    }
    df = spark.createDataFrame([(i, u, "c") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = url_filter.judge_urls(df).orderBy("page_id").collect()
    assert [tuple(r)[1:] for r in got] == list(urls.values())
    assert url_filter.judge_urls(df.limit(0)).count() == 0


def test_colliding_digests_don_t_decide(spark, monkeypatch):
    table_ = spark.createDataFrame([("aa", 1), ("bb", 2), ("c", 3), ("aa", 4), ("dddd", None)], "string string, value int").filter("value IS NOT NULL")
    at = url_filter.DigestArray.write(table_, digest=len)
    assert url_filter.DigestArray(*at, digest=len).find([b"bb", b"zz", b"c", b"aa", b"", b"dddd"]).tolist() == [2, -1, 3, 4, -1, -1]
    assert url_filter.DigestArray(*url_filter.DigestArray.write(table_.limit(0))).find([b"x"]).tolist() == [-1]
    monkeypatch.setattr(url_filter, "SHARD", 10)
    many = spark.range(1000).select(F.concat(F.lit("x"), "id").alias("string"), F.col("id").cast("int").alias("value"))
    at, bits = url_filter.DigestArray.write(many)
    assert bits == 7
    assert url_filter.DigestArray(at, bits).find([f"x{k}".encode() for k in range(-2, 1002)]).tolist() == [-1, -1, *range(1000), -1, -1]


def test_lists_of_urls_come_as_tables(spark):
    pages = spark.createDataFrame([(0, "x://a.spam.net/q"), (1, "x://spam.net/ok/1"), (2, "x://fine.net/")], "page_id long, url string")
    blocked = spark.createDataFrame([("spam.net",), (None,)], "host string")
    rules = spark.createDataFrame([("allow", "spam.net/ok/"), ("block", "net/"), ("allow", "net/"), (None, None)], "verdict string, rule string")
    got = url_filter.judge_urls(pages, rules=rules.limit(1), blocked=blocked).orderBy("page_id").collect()
    assert [(r.rule, r.verdict) for r in got] == [(None, "block"), ("spam.net/ok/", "allow"), (None, "allow")]
    assert [r.verdict for r in url_filter.judge_urls(pages, rules=rules, blocked=[]).orderBy("page_id").collect()] == ["block", "allow", "block"]


# ---------------------------------------------------------------- 9


@pytest.mark.parametrize("dim, n", [(64, 900), (10, 250), (3, 7)])
def test_nearest_are_those_of_brute_force(spark, dim, n):
    rng = np.random.default_rng(dim)
    x = rng.standard_normal((n, dim)).astype(np.float32)
    x[: n // 4] = x[0]  # a vector that a quarter of the rows hold
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5001, [0.0] * dim), (5002, [math.nan] * dim), (5003, [1.0, None, *([2.0] * (dim - 2))]), (5004, [1.0]), (None, x[1].tolist()), (0, x[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("clash")).repartition(3)
    got = collections.defaultdict(list)
    for r in nearest.nearest_neighbours(df).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    x = x.astype(float)
    assert set(got) == set(range(0, n, 100))
    hit = total = 0
    for q, found in got.items():
        far = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        want = [i for i in np.lexsort((np.arange(n), far)) if i != q][:10]
        assert [f[0] for f in found] == list(range(1, len(want) + 1))
        assert all(f[2] == pytest.approx(far[f[1]]) for f in found)
        hit, total = hit + len(set(want) & {f[1] for f in found}), total + len(want)
    assert hit >= 0.99 * total
    assert nearest.nearest_neighbours(df.limit(0)).count() == 0


def test_quota_of_clusters(spark):
    """Where vectors lie in groups few clusters are probed, and the neighbours are those of brute force all the same."""
    rng = np.random.default_rng(5)
    x = (rng.standard_normal((60, 16)) * 5)[rng.integers(0, 60, 6000)] + rng.standard_normal((6000, 16))
    c = nearest.k_means(x, 40)
    assert nearest.quota(x, c, 10) < 10
    spread = rng.standard_normal((3000, 64))
    assert nearest.quota(spread, nearest.k_means(spread, 40), 10) > 20
    assert nearest.quota(x[:1], c, 10) == nearest.quota(x[:0], c, 10) == 40
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    hits = 0
    for r in nearest.nearest_neighbours(df).groupBy("query_id").agg(F.collect_set("vec_id").alias("found")).collect():
        far = ((x - x[r.query_id]) ** 2).sum(axis=1)
        hits += len(set(np.argsort(far)[1:11].tolist()) & set(r.found))
    assert hits >= 0.99 * 600


def test_outliers_find_all_their_neighbours(spark):
    """Groups of very different sizes, and single vectors that became centroids: every query gets k neighbours, nearly all the right ones."""
    rng = np.random.default_rng(11)
    sizes = [9000, 4000, 1000, 300, 50, 5, *([1] * 8)]
    x = np.concatenate([rng.standard_normal(16) * 40 + rng.standard_normal((n, 16)) * rng.uniform(0.5, 3) for n in sizes])
    x[[100, 5600]] = rng.standard_normal((2, 16)) * 400
    x = x[:14_300].round(6)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    got = collections.defaultdict(list)
    for r in nearest.nearest_neighbours(df).collect():
        got[r.query_id].append((r.rank, r.vec_id))
    assert set(got) == set(range(0, len(x), 100)) and all(sorted(r for r, _ in v) == list(range(1, 11)) for v in got.values())
    hits = 0
    for q, found in got.items():
        far = ((x - x[q]) ** 2).sum(axis=1)
        far[q] = np.inf
        hits += len(set(np.argsort(far, kind="stable")[:10].tolist()) & {i for _, i in found})
    assert hits >= 0.99 * 10 * len(got)


def test_an_id_with_several_vectors_is_defined(spark):
    rows = [(i, [float(i), 1.0]) for i in range(1, 300)] + [(100, [5.0, 1.0]), (100, [100.0, 0.5])]
    got = [[(r.rank, r.vec_id) for r in nearest.nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(n), k=3).filter("query_id = 100").orderBy("rank").collect()] for n in (1, 3, 5)]
    assert got[0] == got[1] == got[2] == [(1, 5), (2, 4), (3, 6)]


def test_estimates_are_within_their_bounds():
    rng = np.random.default_rng(0)
    x, q, c, turn = rng.standard_normal((500, 64)), rng.standard_normal((40, 64)), np.zeros(64), nearest.rotation(64)
    guess, least = nearest.estimate(*nearest.encode(x, c, turn), q, c, turn)
    real = ((q[:, None] - x[None]) ** 2).sum(axis=2)
    assert (least <= real + 1e-9).mean() > 0.999 and abs((guess - real).mean()) < 0.5


# ---------------------------------------------------------------- 10


def jaccard(texts, threshold=0.8):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    s = [shingles(t) for t in texts]
    links, root = [0] * len(s), list(range(len(s)))
    for i in range(len(s)):
        for j in range(i):
            if s[i] and s[j] and len(s[i] & s[j]) >= threshold * len(s[i] | s[j]):
                links[i], links[j] = links[i] + 1, links[j] + 1
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return links, root


@pytest.mark.parametrize("bucket, block, every, exact", [(200, 1000, 16, False), (3, 6, 1000, False), (3, 6, 2, False), (3, 6, 2, True)])
def test_near_duplicates_are_those_of_brute_force(spark, monkeypatch, bucket, block, every, exact):
    """As it is; with buckets so small that everything crowds on all levels and groups are cut into blocks; and with groups too large to compare all blocks."""
    monkeypatch.setattr(jaccard_join, "BUCKET", bucket)
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "ALL", every)
    rng = random.Random(10)
    texts = [prose(rng, rng.randint(1, 150)) for _ in range(60)]
    line = prose(rng, 30)
    texts += [f"{line} {prose(rng, 60)}" for _ in range(12)]
    for t in texts[:20]:
        for _ in range(rng.randint(1, 6)):
            w = t.split()
            w[rng.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
    base = prose(rng, 120).split()
    for _ in range(50):  # a group at the threshold, some of it alone
        texts.append(" ".join(x if rng.random() > 0.02 else prose(rng, 2) for x in base))
    texts += [texts[1].upper(), texts[1].replace(" ", "\n"), "a b c", "A  b c", "a b", None, "", " ", None]
    order = list(range(len(texts)))
    rng.shuffle(order)
    texts = [texts[i] for i in order]
    got = jaccard_join.near_duplicates(table(spark, texts).withColumn("class_id", F.lit("clash")).withColumn("key", F.lit("clash")), exact_links=exact).orderBy("doc_id").collect()
    links, root = jaccard(texts)
    assert [r.class_id for r in got] == root
    assert [r.is_first for r in got] == [r == i for i, r in enumerate(root)]
    if every > 2 or exact:
        assert [r.n_links for r in got] == links
    else:
        assert all(r.n_links <= n for r, n in zip(got, links))
        assert sum(r.n_links == n for r, n in zip(got, links)) > len(links) / 2


def test_lm_trains_on_every_piece(spark, monkeypatch):
    """Of a corpus of any size."""
    seen, count = [], lm_scoring.count_words
    monkeypatch.setattr(lm_scoring, "EASY", 1, raising=False)
    monkeypatch.setattr(lm_scoring, "count_words", lambda docs, every, path: (seen.append(every), count(docs, 1, path))[1])
    assert len(lm_scoring.score_texts(table(spark, [*ODD, prose(random.Random(1), 300)])).collect()) == len(ODD) + 1
    assert seen == [1]


def test_toxicity_learns_from_every_labelled_row(spark, monkeypatch):
    """However many; fitted by Spark, weights score as those that the driver fits."""
    seen, count = [], toxicity._counts
    monkeypatch.setattr(toxicity, "TRAIN_ROWS", 20, raising=False)
    monkeypatch.setattr(toxicity, "_counts", lambda sample: seen.append(sample.count()) or count(sample))
    rng = random.Random(12)
    texts = [prose(rng, 40) + (" vile nasty words" if k % 3 == 0 and k % 7 else "") for k in range(400)]
    docs = table(spark, texts)
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(len(texts))], "doc_id long, toxic int")
    alone = toxicity.score_toxicity(docs, labels).orderBy("doc_id").collect()
    assert seen == [sum(not r.held_out for r in alone)]
    monkeypatch.setattr(toxicity, "ALONE", 0)
    by_spark = toxicity.score_toxicity(docs, labels).orderBy("doc_id").collect()
    assert [r.score for r in by_spark] == pytest.approx([r.score for r in alone], abs=0.02)


def test_labels_beyond_twenty_thousand_count(spark):
    """One text a label, tiny texts: the number of rows that counts are taken of."""
    n = 30_000
    docs = spark.range(n).selectExpr("id AS doc_id", "concat('t', id % 7) AS text")
    model = toxicity.train(docs, spark.range(n).selectExpr("id AS doc_id", "CAST(id % 5 = 0 AS int) AS toxic"))
    kept = docs.filter(~toxicity.held_out(F.col("doc_id")))
    pos, neg = kept.filter("doc_id % 5 = 0").count(), kept.filter("doc_id % 5 > 0").count()
    assert model.bias == pytest.approx(np.log((pos + 0.5) / (neg + 0.5)), abs=1e-9)


def test_links_of_large_groups_are_all_counted(spark, monkeypatch):
    """By default, in a group of many more blocks than ALL."""
    for name, value in (("BUCKET", 3), ("BLOCK", 6), ("ALL", 2)):
        monkeypatch.setattr(jaccard_join, name, value)
    rng = random.Random(11)
    base = prose(rng, 120).split()
    texts = [" ".join(x if rng.random() > 0.01 else "changed" for x in base) for _ in range(60)]
    got = jaccard_join.near_duplicates(table(spark, texts)).orderBy("doc_id").collect()
    links, root = jaccard(texts)
    assert [r.n_links for r in got] == links and [r.class_id for r in got] == root


def test_runs_keep_the_recall_on_all_levels():
    """Against the branching process itself."""
    rng, branch = np.random.default_rng(3), jaccard_join.BRANCH
    for t in (0.8, 0.5):
        alive = np.ones(200_000, np.int64)
        for _ in range(jaccard_join.LEVELS):
            alive = rng.poisson(alive * t * branch)
        n = jaccard_join.n_runs(t, 0.99, branch)
        assert (alive == 0).mean() ** n <= 0.0102 < (alive == 0).mean() ** (n - 1)


def test_samples_tell_similarity():
    rng = np.random.default_rng(4)
    for size in (5, 60, 64, 65, 300, 5000):
        guess = []
        for _ in range(200):
            x = rng.integers(0, 2**63, size, np.uint64)
            cut = size // 9
            sets = [x[cut:], np.concatenate((x[: size - cut], rng.integers(0, 2**63, size // 20, np.uint64)))]
            sizes = np.array([len(y) for y in sets])
            samples = [np.sort(h[h < b]) for h, b in zip((jaccard_join.mix(y, 50) for y in sets), jaccard_join.share(sizes))]
            guess.append(jaccard_join.similar(sizes, samples)[0, 1])
        real = len(set(sets[0].tolist()) & set(sets[1].tolist())) / len(set(sets[0].tolist()) | set(sets[1].tolist()))
        assert np.mean(guess) == pytest.approx(real, abs=0.015)
        assert np.std(guess) < (1e-9 if size <= 64 else 0.07)


def test_crowded_pairs_at_the_threshold_are_found(spark, monkeypatch):
    """Groups whose paths are split on all levels, each of pairs of similarity 0.81; what crowds the last level is not told apart from what doesn't."""
    monkeypatch.setattr(jaccard_join, "BUCKET", 3)
    monkeypatch.setattr(jaccard_join, "BLOCK", 6)
    rng, texts = random.Random(12), []
    for _ in range(60):
        base = prose(rng, 100).split()
        for k in range(10, 90, 8):
            texts.append(" ".join([*base[:k], f"changed{k}", *base[k + 1 :]]))
    got = [r.n_links for r in jaccard_join.near_duplicates(table(spark, texts)).orderBy("doc_id").collect()]
    assert sum(got) >= jaccard_join.RECALL * 9 * len(texts)


@pytest.mark.parametrize("shared, linked", [(204, False), (460, True)])
def test_texts_sent_grow_with_a_group(spark, monkeypatch, shared, linked):
    """Sets that look alike without links (J = 0.68), and near copies (J = 0.83): twice the group, twice the texts sent, at most twice each; the classes are right."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 20)
    sent, deal = [], jaccard_join._deal

    def counted(texts, side):
        rows = deal(texts, side)
        sent[-1] += rows.count()
        return rows

    monkeypatch.setattr(jaccard_join, "_deal", counted)
    rng = random.Random(31)
    base, words = prose(rng, shared), iter(range(10**9))
    for n in (400, 800):
        sent.append(0)
        texts = [f"{base} {' '.join(f'own{next(words)}' for _ in range(47))}" for _ in range(n)]
        got = jaccard_join.near_duplicates(table(spark, texts)).collect()
        assert {r.class_id for r in got} == ({0} if linked else set(range(n))) and (linked or all(r.n_links == 0 for r in got))
        assert n <= sent[-1] <= 2 * n
    assert sent[1] <= 2 * sent[0]


def test_near_duplicates_odd_tables(spark, odd, empty):
    assert jaccard_join.near_duplicates(empty).count() == 0
    got = jaccard_join.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    blank = [r for r in got if r.text in (None, "", "   \n")]
    assert all(r.n_links == 0 and r.is_first for r in blank)
    assert sorted(r.n_links for r in got if r.text == "one") == [1, 1] and sum(r.is_first for r in got if r.text == "one") == 1


def test_gradient_takes_all_classes_at_once(monkeypatch):
    """Three calls of exp, of attention, classes and members, not one for each class."""
    calls, exp = [], np.exp
    rng, flat, table = np.random.default_rng(4), attention.initial(), a_table()
    x, y = (rng.integers(0, attention.SLOTS, (64, attention.CONTEXT)).astype(np.int16) for _ in range(2))
    monkeypatch.setattr(np, "exp", lambda *a, **k: (calls.append(1), exp(*a, **k))[1])
    attention.gradient(attention.unpack(flat), table, x, y, attention.unpack(np.zeros_like(flat)))
    assert len(calls) == 3


def test_gradient_of_extreme_weights():
    """Slopes are right where exponents would be too large or all too small."""
    rng, table = np.random.default_rng(5), a_table()
    x, y = (rng.integers(0, attention.SLOTS, (2, attention.CONTEXT)) for _ in range(2))
    for shift in (300.0, -300.0):
        flat = attention.initial().astype(np.float64)
        p = attention.unpack(flat)
        p["b"] += 1
        p["c"] += shift
        p["m"] += shift
        p["a"] += shift
        plain, g = attention.initial().astype(np.float64), np.zeros_like(flat)
        attention.unpack(plain)["b"][:] += 1
        loss = attention.gradient(p, table, x, y, attention.unpack(g))
        want = np.zeros_like(flat)
        assert loss == pytest.approx(attention.gradient(attention.unpack(plain), table, x, y, attention.unpack(want)), abs=1e-6)  # a shift changes no share
        for name in ("c", "m", "a"):
            assert attention.unpack(g)[name] == pytest.approx(attention.unpack(want)[name], abs=1e-6)


def test_toxicity_shuffles_only_labelled_texts(spark, monkeypatch):
    """Documents without a label are left out before the join, whatever the type of ids; nothing stays behind in the shared folder."""
    kept, made = toxicity.materialise, []

    def watched(df, tag):
        out = kept(df, tag)
        made.append((tag, out._written_to))
        return out

    monkeypatch.setattr(toxicity, "materialise", watched)
    for bits in (26, 3):  # with few bits most documents pass, and the result is the same
        monkeypatch.setattr(toxicity, "MARKS", bits, raising=False)
        for kind in ("long", "string"):
            docs = spark.range(3000).selectExpr(f"CAST(id AS {kind}) AS doc_id", "concat('some text ', id % 7) AS text").union(spark.sql(f"SELECT CAST(NULL AS {kind}), 'none'"))
            labels = spark.range(0, 3000, 30).selectExpr(f"CAST(id AS {kind}) AS doc_id", "CAST(id % 60 = 0 AS int) AS toxic")
            own = labels.filter(~toxicity.held_out(F.col("doc_id"))).agg(F.sum("toxic"), F.count("toxic")).first()
            model = toxicity.train(docs, labels)
            if not (model.slots >= 0).any():
                assert model.bias == pytest.approx(np.log((own[0] + 0.5) / (own[1] - own[0] + 0.5)), abs=1e-9)
            rows = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"))
            left = toxicity._likely(rows, labels.select(F.col("doc_id").alias("_id")))
            assert left.join(labels, F.col("_id") == F.col("doc_id"), "left_semi").count() == 100
            assert left.count() < 110 or bits == 3
    assert toxicity._likely(rows, labels.selectExpr("CAST(doc_id AS int) AS _id")) is rows
    assert made
    for _, path in made:
        fs, place = file_system(path)
        assert fs.get_file_info(place).type.name == "NotFound"


def test_gradient_makes_projections_once_for_each_token():
    """Of 64 windows of two different tokens only two rows go through the queries' weights."""
    rows, table, flat = [], a_table(), attention.initial()
    x = np.random.default_rng(6).integers(7, 9, (64, attention.CONTEXT)).astype(np.int16)
    taken = attention.unpack(flat)["e"].view(type("Seen", (np.ndarray,), {"take": lambda self, at, **k: (rows.append(np.size(at)), np.asarray(self).take(at, **k))[1]}))
    p = attention.unpack(flat) | {"e": taken}
    attention.gradient(p, table, x, x, attention.unpack(np.zeros_like(flat)))
    assert rows == [2]


def test_lm_pieces_are_ids_in_full_windows(spark, monkeypatch):
    """Training looks up no words again, and of a long text's windows the first and the last of a piece alone are part empty."""
    import pyarrow as pa

    texts, path = [prose(random.Random(8), n) for n in (5000, 1)], public_tokenizers.path(lm_scoring.VOCABULARY)
    counts, pieces = lm_scoring.count_words(table(spark, texts).select("text", F.lit(False).alias("held_out")), 1, path)
    vocabulary, rows = lm_scoring.Vocabulary(lm_scoring.count_subwords(counts, path)), pieces.collect()
    monkeypatch.setattr(lm_scoring, "subwords", None)
    x, y = lm_scoring.windows_of(pa.array([bytes(r.piece) for r in rows], pa.binary()), [r.edge for r in rows], lm_scoring.Trainer(vocabulary, np.zeros((1, 1))))
    assert (x < 0).any(axis=1).sum() <= 2 * len(rows) <= 12 and ((x < 0) == (y < 0)).all()
    monkeypatch.undo()
    want = [np.concatenate(([0], *(vocabulary.slot[lm_scoring.encoder(path).encode_ordinary(" " + w.decode())] for w in t.encode().lower().split()), [0])) for t in texts]
    follow = collections.Counter(k for own in want for k in zip(own[:-1].tolist(), own[1:].tolist()))
    assert collections.Counter(zip(x[x >= 0].tolist(), y[y >= 0].tolist())) == follow


def test_subwords_with_blanks_inside():
    """All kinds of blanks that Unicode has and ASCII words may hold: as each word by itself."""
    path = public_tokenizers.path(lm_scoring.VOCABULARY)
    code = lm_scoring.encoder(path).encode_ordinary
    for words in ([], ["ab"], ["ab", "ünd"], ["a\u2003b", "\u2003", "c"], ["\u00a0x", "y\u0085"], ["a\x1cb", "z"]):
        ids, at = lm_scoring.subwords([w.encode() for w in words], path)
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [code(" " + w) for w in words]
