"""The training-data operators against brute force, on small tables with every odd case."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

import corpus_pipeline
from corpusloom.llm import chat, packing, pieces, quality, queries, simhash, suffix, topk, toxicity, warc, wrapper

SF = "/root/testdata/sf0.001"


def odd_texts():
    rng = random.Random(5)
    vocab = ["".join(rng.choices("abcdeéß", k=rng.randint(1, 7))) for _ in range(300)]
    passage = " ".join(rng.choices(vocab, k=70))
    out = [None, "", "   \n ", "one", passage, passage, f"Start {passage}", f"x {passage} y\n{passage}", "a" * 700, "ab" * 400, "\0" * 450, "<|endoftext|> Σίσυφοσ Σ"]
    out += [" ".join(rng.choices(vocab, k=rng.randint(3, 120))) + "\n" + "same line here\nsame line here" for _ in range(25)]
    out.append(" ".join(rng.choices(vocab, k=6000)))
    base = rng.choices(vocab, k=400)
    for i in range(6):
        near = base[:]
        near[i] = "changed"
        out.append(" ".join(near))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "src0" if i % 2 else None, len(t or ""), f"fp{i}", i, "k") for i, t in enumerate(odd_texts())]
    rows.append((None, "no id", "en", "src0", 5, "f", 0, "k"))
    # id, fp and key clash with names the operators use inside
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp string, id int, key string").repartition(3).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.filter("false")


def rows_of(docs):
    return [(r["doc_id"], (r["text"] or "").encode()) for r in docs.collect()]


def test_simhash(docs, empty):
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs, block=2).collect()}
    fps = {k: simhash.fingerprint(t) for k, t in rows_of(docs)}
    assert {k: f"{v:016x}" for k, v in fps.items()} == {k: r["fingerprint"] for k, r in got.items()}
    ids = sorted(k for k in fps if k is not None)
    home = {i: i for i in ids}
    for _ in ids:
        for a in ids:
            home[a] = min(home[b] for b in ids if (fps[a] ^ fps[b]).bit_count() <= 3)
    assert {k: r["component_id"] for k, r in got.items() if k is not None} == home
    assert simhash.near_duplicates(empty).count() == 0


def test_bk_tree():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, 40, np.uint64)
    values = np.unique(np.concatenate([base ^ (np.uint64(1) << rng.integers(0, 64, 40, np.uint64)) for _ in range(8)]))
    for radius in (0, 3, 7):
        tree = simhash.BKTree.grow(rng.permutation(values))
        for node in range(1, len(values)):  # children are keyed by their distance to the parent, once each
            parent, edge = divmod(int(tree.edges[node]), 65)
            assert parent < node and int(tree.values[node] ^ tree.values[parent]).bit_count() == edge
        assert len(set(tree.edges)) == len(values) and (np.diff(tree.edges) > 0).all()
        found = [(int(values[q]), int(tree.values[n])) for qs, ns in tree.search(values, radius) for q, n in zip(qs, ns, strict=True)]
        assert len(found) == len(set(found))
        assert set(found) == {(int(a), int(b)) for a in values for b in values if int(a ^ b).bit_count() <= radius}
    assert not list(simhash.BKTree.grow(values[:0]).search(values)) and not list(simhash.BKTree.grow(values).search(values[:0]))


@pytest.mark.parametrize(("radius", "size", "block"), [(3, 256, 4096), (3, 2, 4096), (3, 2, 3), (3, 1 << 20, 16), (5, 8, 4096), (3, 1e-9, 4096)])
def test_links_connect_all_within_the_radius(spark, radius, size, block):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 30, np.uint64)
    values = base
    for _ in range(3):
        values = np.unique(np.concatenate([values, base ^ (np.uint64(1) << rng.integers(0, 64, 30, np.uint64)) ^ (np.uint64(3) << rng.integers(0, 62, 30, np.uint64))]))
    got = simhash.links(spark.createDataFrame([(int(x),) for x in values.view(np.int64)] * 2, "fp long"), radius, block, size).collect()
    assert len(simhash.layout(len(values), radius, size)) == {1e-9: 10, 1 << 20: 1}.get(size, 1 if size == 256 else radius + 1)
    home = {int(x): int(x) for x in values.view(np.int64)}

    def joined(pairs):
        out = dict(home)
        for a, b in pairs:
            old, new = max(out[a], out[b]), min(out[a], out[b])
            out = {k: new if v == old else v for k, v in out.items()}
        return out

    signed = values.view(np.int64)
    near = [(int(a), int(b)) for a in signed for b in signed if a < b and int(np.uint64(int(a) & (1 << 64) - 1) ^ np.uint64(int(b) & (1 << 64) - 1)).bit_count() <= radius]
    assert joined((r["a"], r["b"]) for r in got) == joined(near)


def brute_repeats(rows, width=200):
    seen = Counter(t[i : i + width] for _, t in rows for i in range(len(t) - width + 1))
    out = {}
    for k, t in rows:
        marks = np.zeros(len(t) + 1, int)
        for i in range(len(t) - width + 1):
            if seen[t[i : i + width]] > 1:
                marks[i] += 1
                marks[i + width] -= 1
        on = np.cumsum(marks)[:-1] > 0
        rest = np.frombuffer(t, np.uint8)[~on].tobytes()
        out[k] = (len(t), int(on.sum()), int((np.diff(np.r_[0, on.astype(int)]) == 1).sum()), rest)
    return out


@pytest.mark.parametrize("block", [2, suffix.BLOCK])
def test_suffix(docs, empty, block):
    want = brute_repeats(rows_of(docs))
    got = suffix.without_repeats(docs, block=block).collect()
    assert len(got) == len(want)
    for r in got:
        n, removed, spans, rest = want[r["id"]]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"]) == (n, removed, spans), r["id"]
        assert r["rest"] is None or r["rest"] == rest
    assert suffix.without_repeats(empty).count() == 0


@pytest.mark.parametrize("block", [2, suffix.BLOCK])
def test_suffix_keeps_rows_that_share_an_id(spark, block):
    rng = random.Random(11)
    own = lambda n: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(n))
    passage = own(60)
    texts = [(1, f"{own(30)} {passage} {own(20)}"), (1, f"{own(50)} {passage}"), (1, own(80)), (1, None), (None, f"{passage} {own(40)}"), (None, f"{own(9)} {passage}"), (2, own(70))]
    texts += [(3, f"{own(10 + k)} {passage} {own(k)}") for k in range(9)] + [(2, texts[-1][1])]
    table = spark.createDataFrame([(*r, 5, "c") for r in texts], "doc_id long, text string, own int, digest string").repartition(4)
    keyed = [(k, (t or "").encode()) for k, (_, t) in enumerate(texts)]
    show = lambda x: repr(x)
    want = sorted(show((texts[k][0], *v[:3])) for k, v in brute_repeats(keyed).items())
    got = suffix.without_repeats(table, block=block).collect()
    assert sorted(show((r["id"], r["n_bytes"], r["n_removed"], r["n_spans"])) for r in got) == want
    left = sorted(show((texts[k][0], v[3].decode() if v[1] else texts[k][1])) for k, v in brute_repeats(keyed).items())
    assert sorted(show((r["doc_id"], r["text"])) for r in suffix.cut(table).collect()) == left


def test_maximal_repeats():
    a, b = bytes(range(65, 91)) * 2, b"xyz"
    texts = [b"1" + a + b"2", b"3" + a + b"4" + b, b"nothing"]
    got = suffix.maximal_repeats(texts, floor=8)
    assert (a, [(0, 1), (1, 1)]) in got
    for text, spots in got:  # all occurrences, and not extendable to either side
        assert sorted(spots) == sorted((i, p) for i, t in enumerate(texts) for p in range(len(t)) if t.startswith(text, p))
        left = {texts[i][p - 1 : p] or (i, p) for i, p in spots}
        right = {texts[i][p + len(text) : p + len(text) + 1] or (i, p) for i, p in spots}
        assert len(left) > 1 and len(right) > 1


def test_the_suffix_array_is_in_lexicographic_order():
    rng = random.Random(7)
    part = bytes(rng.choices(b"ab\0\xff", k=300))
    texts = [bytes(rng.choices(b"ab", k=rng.randint(0, 60))) + part[: rng.randint(20, 300)] for _ in range(30)] + [b"a" * 90, b"ab" * 50]
    for floor in (8, 16, 24):
        used = [t for t in texts if len(t) >= floor]
        cap = floor + 32
        place, groups, cls, _ = suffix.bucket_groups(used, np.array([len(t) - floor + 1 for t in used]), np.zeros(len(used), np.int64), floor, cap)
        ends = np.cumsum([len(t) for t in used])
        flat = b"".join(used)
        own = lambda p: flat[p : min(p + cap, ends[np.searchsorted(ends, p, "right")])]  # noqa: E731, B023
        suffixes = [own(p) for p, c in zip(place, cls, strict=True) if c >= 0]
        assert all(a.ljust(cap, b"\0") <= b.ljust(cap, b"\0") for a, b in zip(suffixes, suffixes[1:], strict=False))
        assert Counter(x[:floor] for x in suffixes) == {k: n for k, n in Counter(t[i : i + floor] for t in used for i in range(len(t) - floor + 1)).items() if n > 1}
        for lo, hi, n in groups:  # intervals: all that share n bytes, and no more at both ends
            assert len({x[:n] for x in suffixes[lo:hi]}) == 1 and hi - lo > 1
            assert all(k < 0 or k >= len(suffixes) or suffixes[k][:n] != suffixes[lo][:n] or len(suffixes[k]) < n for k in (lo - 1, hi))


def test_quality(spark, docs, empty):
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "source").toPandas())
    want = con.sql(quality.SQL).df()
    got = quality.judge(docs).toPandas()
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    got, want = (x[x.doc_id.notna()][cols].sort_values("doc_id").reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(got, want, check_dtype=False)
    assert quality.judge(empty).count() == 0


def test_depleted_documents_go(spark):
    """The verdict of the line rule against plain Python: some documents go, most stay."""
    rng = random.Random(13)
    say = lambda n: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n))
    shared = [f"Line {k} {say(12)}" for k in range(6)]
    rows = []
    for k in range(60):
        lines = rng.sample(shared, rng.choice((0, 0, 1, 4, 6))) + [say(rng.choice((20, 45, 60)))] + [say(9)] * rng.choice((0, 2))
        lines = [x.upper().replace("LINE", "  line\t") if rng.random() < 0.3 else x for x in lines]
        rows.append((None if k == 7 else k % 50, "\n".join(lines), rng.choice(("a", "a", "a", "b", None))))
    rows += [rows[0], rows[0], (99, None, "a"), (98, "", "b")]
    plain = lambda x: "".join("0" if c.isdigit() else c for c in " ".join(x.lower().split()))
    hosts = Counter(h for *_, h in rows)
    held = Counter((h, x) for _, t, h in rows for x in {plain(y) for y in (t or "").split("\n") if y.split()})
    gone = {k for k, n in held.items() if n > 5 and 100 * n > 10 * hosts[k[0]]}
    want = []
    for i, t, h in rows:
        words = (t or "").split()
        windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        times = Counter(windows)
        again = {k + d for k, w in enumerate(windows) if times[w] > 1 for d in range(3)}
        failed = len(words) < 50 or 100 * len(again) > 50 * len(words)
        left = sum(len(x.split()) for x in (t or "").split("\n") if (h, plain(x)) not in gone)
        want.append((i, len(words), len(again), failed, left, not failed and left >= 50 and 2 * left >= len(words)))
    got = [(r["doc_id"], r["n_words"], r["n_repeat_words"], r["base_failed"], r["n_left"], r["kept"]) for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert 3 < sum(not failed and not kept for *_, failed, _, kept in want) < sum(kept for *_, kept in want)


def test_windows_that_share_a_hash_are_told_apart(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(quality, "_hash", lambda *parts: F.pmod(F.xxhash64(*parts), F.lit(3)))
    rng = random.Random(14)
    rows = [(k, " ".join(rng.choices("abcd", k=rng.randint(0, 40))), "h") for k in range(60)]
    got = {r["doc_id"]: r["n_repeat_words"] for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    for k, t, _ in rows:
        words = t.split()
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        assert got[k] == len({i + d for i, w in enumerate(windows) if windows.count(w) > 1 for d in range(3)})


def plain_grams(text):
    """Buckets of all n-grams of a text, each hashed on its own."""
    text = " " + "".join(" " if "\t" <= c <= "\r" else c.lower() if c.isascii() else c for c in text) + " "
    last = lambda gram: int([s for n, s in toxicity._slots(toxicity._points(gram)) if n == len(gram)][0][0])
    return Counter(last(text[i : i + n]) for n in toxicity.SIZES for i in range(len(text) - n + 1))


def test_toxicity_scores_are_sums_over_character_ngrams(monkeypatch):
    monkeypatch.setattr(toxicity, "PIECE", 40)
    rng = random.Random(3)
    texts = ["", "é", "ÀB\tc ß漢字🙂x", "Z" * 200] + ["".join(rng.choices("abcdéñß漢 \n", k=rng.randint(1, 150))) for _ in range(20)]
    labels = [k % 2 for k in range(len(texts))]
    rows = [toxicity.features(t) for t in texts]
    assert [dict(zip(map(int, s), map(int, n), strict=True)) for s, n in rows] == [plain_grams(t) for t in texts]
    p, q = Counter(), Counter()
    for t, y in zip(texts, labels, strict=True):
        (p if y else q).update(plain_grams(t))
    parts = toxicity.packed(rows, 30)
    assert len(parts) > 3
    ratio = toxicity.ratios(parts, labels)
    size = 1 << toxicity.BITS
    for k in {*p, *q}:
        assert ratio[k] == pytest.approx(np.log((p[k] + 1) / (p.total() + size)) - np.log((q[k] + 1) / (q.total() + size)))
    assert np.count_nonzero(ratio) <= len({*p, *q})
    model = toxicity.fit(parts, labels)
    for t, score in zip(texts, model.scores(texts), strict=True):
        grams = plain_grams(t)
        z = sum(n * float(model.weight[k]) for k, n in grams.items()) / max(sum(n * ratio[k] ** 2 for k, n in grams.items()), 1e-9) ** 0.5
        assert score == pytest.approx(1 / (1 + np.exp(-(z + model.bias))), abs=1e-5)


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(packing.tokenizer_path())
    want = {}
    for k, t in rows_of(docs):
        ids = [*library.encode(t.decode(), add_special_tokens=False).ids, 0]
        for p, at in enumerate(range(0, len(ids), 256)):
            part = ids[at : at + 256]
            want[k, p] = (at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    got = packing.pack(packing.pieces(docs, 256), 256, attention=256 * 256, documents=3).toPandas()
    assert {(None if pd.isna(r.doc_id) else r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got.itertuples()} == want
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.length.sum() <= 256 and len(s) <= 3 and (s.offset.values == np.r_[0, s.length.cumsum().values[:-1]]).all()
    assert packing.pack(packing.pieces(empty)).count() == 0


@pytest.mark.parametrize("by", ["norm", "dot"])
def test_bins_choose_the_best(by):
    rng = random.Random(2)
    bins = packing.Bins(64, 3, 2000, (1.0, 0.5, 0.5), by)
    open_: dict = {}
    for n in sorted((rng.randint(1, 44) for _ in range(300)), reverse=True):
        def value(b, n=n):
            r, d, a = b
            if by == "norm":
                return ((r - n) / 64) ** 2 + 0.5 * ((d - 1) / 3) ** 2 + 0.5 * ((a - n * n) / 2000) ** 2
            return -(n * r / 64**2 + 0.5 * d / 9 + 0.5 * n * n * a / 2000**2)
        fits = [value(b) for b in open_.values() if b[0] >= n and b[1] >= 1 and b[2] >= n * n]
        number, offset = bins.place(n)
        old = open_.get(number, (64, 3, 2000))
        assert offset == 64 - old[0]
        assert (number not in open_) == (not fits) and (not fits or value(old) == pytest.approx(min(fits)))
        open_[number] = (old[0] - n, old[1] - 1, old[2] - n * n)


def test_chat(spark):
    rows = [(1, 1, "assistant", "a <s> </s> <\\/s> [INST] [\\\\/INST] <</SYS>> [ROLE=x] é"), (1, 0, "system", None), (1, 2, None, "[/ROLE]"), (1, 2, "tool]", "["), (None, 0, "user", " "), (2, 0, "assistant", ""), (2, None, "user", "x" * 50000), (2, 0, "assistant", "")]
    table = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r["conv_id"]: r for r in chat.digests(chat.formatted(table)).collect()}
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t if t is not None else -1, r or "", x or ""))
    for c, turns in by.items():
        turns.sort()
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert (got[c]["n_turns"], got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.digests(chat.formatted(table.filter("false"))).count() == 0
    for x in ("<", "<<s>", "[[INST]", "<\\", "<\\\\/s></s>", "</SYS>> <<SYS>>"):
        assert chat.unescape(chat.escape(x.encode())) == x.encode()
        assert list(chat.turns(b"<s>[INST] " + chat.escape(x.encode()) + b" [/INST]")) == [("user", x)]


def test_topk(spark):
    rng = np.random.default_rng(3)
    values = rng.normal(size=(120, 6)).astype("float32")
    values[60:100] = values[60]
    rows = [(i, [float(x) for x in v], "q") for i, v in enumerate(values)]
    rows += [(200, None, "q"), (250, [1.0, float("nan")], "q"), (300, [], "q"), (350, [1.0, None], "q"), (None, [1.0] * 6, "q"), (400, [2.0, 3.0], "q"), (450, [1.0, 1.0], "q")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, id string")
    vectors = topk.quantised(table)
    got = defaultdict(list)
    for r in topk.top_k(vectors, vectors.filter("id % 50 = 0")).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    fine = {r[0]: np.floor(np.array(r[1], float) * 256).astype(int) for r in rows if r[0] is not None and r[1] and None not in r[1] and np.isfinite(r[1]).all()}
    for q in (i for i in fine if i % 50 == 0):
        want = sorted(((int(v @ fine[q]), i) for i, v in fine.items() if i != q and len(v) == len(fine[q])), key=lambda x: (-x[0], x[1]))[:5]
        assert got.pop(q, []) == [(i, s) for s, i in want]
    assert not got and topk.top_k(vectors.filter("false"), vectors.filter("false")).count() == 0
    for big in (1e30, -1e15):
        with pytest.raises(Exception, match="too large"):
            topk.quantised(spark.createDataFrame([(1, [big, 0.0])], "vec_id long, embedding array<double>")).collect()


@pytest.mark.parametrize("mode", ["viterbi", "bpe"])
def test_pieces(spark, mode):
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=pieces.model_path())
    texts = [None, "", " ", "  two  spaces", "Thing and 漢字 🙂\nline\t", "x" * 60, "naïve café", "same", "same", "a" * 3000 + " é" * 300 + "\0" * 700]
    # ids, score and word clash with names the operator uses inside
    table = spark.createDataFrame([(t, 7, "w", 0.5, 3) for t in texts], "text string, ids int, word string, score double, at int")
    pt = pieces.piece_table(spark)
    coded = pieces.encode(table, "text", pt, mode).cache()
    got = coded.collect()
    assert sorted(r["text"] or "" for r in got) == sorted(t or "" for t in texts) and all((r["word"], r["at"]) == ("w", 3) for r in got)
    if mode == "bpe":
        for r in got:
            assert list(r["ids"]) == library.encode(r["text"] or ""), r["text"]
    back = pieces.decode(coded, pt).collect()
    assert all(r["decoded"] == (r["text"] or "") for r in back) and len(back) == len(texts)
    assert [r["decoded"] for r in pieces.decode(spark.createDataFrame([(None,), ([-1, 10**6, None],)], "ids array<int>"), pt).collect()] == ["", ""]
    assert pieces.encode(table.filter("false"), "text", pt, mode).count() == 0


BYTES = [(f"<0x{i:02X}>", 100 + i, 0.0, "byte", bytes([i])) for i in range(256)]
PIECES = "piece string, piece_id int, score double, kind string, bytes binary"


def random_models():
    rng = random.Random(9)
    for _ in range(3):
        names = sorted({"".join(rng.choices("abé", k=rng.randint(2, 6))) for _ in range(24)})
        yield rng, {x: -float(k) for k, x in enumerate(rng.sample(names, len(names)), 1)} | {"a": -90.0, "b": -91.0}


def test_merges_are_the_best_of_their_time():
    for rng, scores in random_models():  # scores at random, so that a merge often opens a better one
        for _ in range(60):
            word = "".join(rng.choices("abé", k=rng.randint(1, 14)))
            parts = list(word)
            while joins := [(-scores[x + y], i) for i, (x, y) in enumerate(zip(parts, parts[1:], strict=False)) if x + y in scores]:
                i = min(joins)[1]
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            assert pieces.merged(word, {x: (0, s) for x, s in scores.items()}) == parts


def test_viterbi_finds_the_best_total(spark, monkeypatch):
    monkeypatch.setattr(pieces, "CHUNK", 5)  # words over several chunks and blocks
    monkeypatch.setattr(pieces, "BLOCK", 3)
    for rng, scores in random_models():
        number = {x: k for k, x in enumerate(scores)}
        pt = spark.createDataFrame([(x, number[x], s, "normal", x.encode()) for x, s in scores.items()] + BYTES, PIECES)
        words = {"".join(rng.choices("abé", k=rng.randint(1, 12))) for _ in range(60)} | {"".join(rng.choices("abé", k=40))}
        unknown = min(scores.values()) - 10

        def cost(piece, scores=scores, unknown=unknown):
            return scores.get(piece, unknown if len(piece) == 1 else None)

        def best(word, cost=cost):  # totals of all ways to each place
            totals = [0.0]
            for end in range(1, len(word) + 1):
                totals.append(max(totals[i] + c for i in range(max(0, end - 6), end) if (c := cost(word[i:end])) is not None))
            return totals[-1]

        def every(word, cost=cost):
            return max((sum(cost(x) for x in cut) for cut in cuts(word) if all(cost(x) is not None for x in cut)), default=None)

        def cuts(word):
            return [[word]] + [[word[:i], *rest] for i in range(1, len(word)) for rest in cuts(word[i:])] if word else [[]]

        spelled = {v: k for k, v in number.items()}
        got = pieces.vocabulary(spark.createDataFrame([(w,) for w in words], "word string"), pt).collect()
        assert {r["word"] for r in got} == words
        for r in got:
            assert r["score"] == pytest.approx(best(r["word"]))
            if len(r["word"]) <= 9:
                assert best(r["word"]) == every(r["word"])
            parts = b"".join(spelled[i].encode() if i in spelled else bytes([i - 100]) for i in r["ids"])
            assert parts.decode() == r["word"]
            n_unknown = sum(i >= 100 for i in r["ids"]) // 2  # é takes two bytes
            assert r["score"] == pytest.approx(sum(scores[spelled[i]] for i in r["ids"] if i in spelled) + n_unknown * unknown)


def test_warc(spark, tmp_path):
    rows = [(1, "http://www.a.example/x?y=1", "<p>é</p>"), (2, "http://b.example:8080/", "<p>é</p>"), (3, None, None), (4, "http://[bad", ""), (5, "http://a.example/\r\nInjected: 1", "z" * 100_000), (9, "http://www.a.example/x?y=1", "<p>é</p>"), (-7, "ü", "q")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, key string")
    folder = f"file://{tmp_path}"
    shards = warc.write_index(warc.write_archives(pages, folder), folder)
    got = {r["page_id"]: r for r in warc.look_up(warc.keys_of(pages), folder, shards).collect()}
    leader = {}
    for i, _, h in rows:
        leader[h or ""] = max(i, leader.get(h or "", -99))
    for i, _, h in rows:
        data = (h or "").encode()
        lead = leader[h or ""]
        assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len(data), warc.digest(data))
        assert (got[i]["record_type"], got[i]["refers_to"]) == (("response", None) if lead == i else ("revisit", lead))
    assert len(got) == len(rows)
    none = spark.createDataFrame([("nowhere",)], "key string")
    assert warc.look_up(none, folder, shards).count() == 0
    assert warc.write_index(warc.write_archives(pages.filter("false"), folder), folder) == []


def page(body, nav=3):
    links = "".join(f"<li><a href=/{i}>n{i}</a>" for i in range(nav))
    return f"<html><head><title>t</title><script>var a='</p>'</script></head><body><nav><ul>{links}</ul></nav><div class='ad big'>buy</div><article><h1>T &amp; t</h1>{body}</article><section id=comments><p>me too</p></section><footer>f</footer></body>"


def test_wrapper(spark):
    rows = [(1, "http://h.example/1", page("<p>one <b>bold</b>word<p>two&nbsp;  x", 2)), (2, "http://h.example/2", page("<p>only</p><ul><li>a<li>b</ul>", 9)), (3, "http://h.example/3", "<p>no article</p><aside>x</aside>"), (4, None, None), (5, "http://o.example/", "plain <!-- no --> text<form>f</form>"), (6, "x", "<div class='cookie-notice'>c</div>" + "<div>" * 300 + "deep")]
    got = {r["page_id"]: r for r in wrapper.main_texts(spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, host string")).collect()}
    want = {1: "T & t\n\none boldword\n\ntwo x", 2: "T & t\n\nonly\n\na\n\nb", 3: "no article", 4: "", 5: "plain text", 6: "deep"}
    assert {k: r["text"] for k, r in got.items()} == want and all(r["n_chars"] == len(r["text"]) for r in got.values())
    a, b = (wrapper.stream(wrapper.read(page(x))) for x in ("<p>a</p><p>b</p>", "<p>a</p><table><tr><td>c</td></tr></table>"))
    both = wrapper.align(a, b)
    names = lambda w: [wrapper.key(n) for n in w]
    assert names(wrapper.align(both, a)) == names(wrapper.align(both, b)) == names(both) != names(a)


def test_common_subsequences_are_longest():
    rng = random.Random(6)
    for _ in range(200):
        a, b = ("".join(rng.choices("abcd", k=rng.randint(0, 40))) for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a) - 1, -1, -1):
            for j in range(len(b) - 1, -1, -1):
                best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
        got = wrapper.common(list(a), list(b))
        assert len(got) == best[0][0] and all(a[i] == b[j] for i, j in got)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:], strict=False))
    x = [str(k % 977) for k in range(6000)]
    assert len(wrapper.common(x, x[3:3000] + ["new"] + x[3000:])) == 5997


def test_folding():
    shape = lambda html: [wrapper.key(n) for n in wrapper.stream(wrapper.read(html))]
    one = "".join(f"<{x}>t</{x}>" for x in ("h2", "p", "ul", "pre", "dl", "h3", "div", "ol", "p", "table", "h4", "p", "section", "h5", "p"))  # 15 siblings
    assert len(shape(one * 2)) == len(shape(one * 7)) == 1 and shape(one * 2) == shape(one * 7) and shape(one)[0] != shape(one * 2)[0]
    assert shape("<ul><li>a<li>b</ul>") == shape("<ul><li>c<li>d<li>e</ul>") != shape("<ul><li>a</ul>")
    assert shape("<p>a</p><p>b<p>c<hr>") == shape("<p>a</p><p>b<hr>")
    assert shape("") == [] and len(shape("x" * 10)) == 1


def test_the_wrapper_decides_without_telling_names(spark):
    """Notices and menus in plain elements: what is the same text on a host's pages is the template's, found by aligning them."""
    rng = random.Random(12)
    say = lambda: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(12))
    menu = "<div class=x1><ul><li><a href=/>Start</a><li>Prices</ul></div>"
    notice = "<div>We keep <b>crumbs</b> of your visit</div>"
    rows, want = [], {}
    for k in range(8):
        parts = [say() for _ in range(2 + k % 3)]
        # the notice stands on some pages only, in an element as the text's own
        rows.append((k, f"http://plain.example/{k}", f"<body>{menu if k != 5 else ''}{notice if k % 2 else ''}<h1>Title {k}</h1><div>{parts[0]}</div><p>All rights kept</p>" + "".join(f"<section><p>{x}</p></section>" for x in parts[1:]) + "</body>"))
        want[k] = "\n\n".join([f"Title {k}", *parts])
    rows.append((20, "http://pair.example/1", "<div>Same text</div><p>one</p>"))  # two pages may be copies of each other
    rows.append((21, "http://pair.example/2", "<div>Same text</div><p>two</p>"))
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in wrapper.main_texts(table).collect()}
    assert got == want | {20: "Same text\n\none", 21: "Same text\n\ntwo"}
    alone = {k: wrapper.main_text(h) for k, _, h in rows if k < 20}
    assert all(alone[k] != want[k] for k in alone)  # without the host's wrapper the template's texts stay
    # the notice's place has other texts on pages without it, so that only the alignment tells it from them
    by_place = Counter((place, x) for k, _, h in rows if k < 20 for kind, x, place in wrapper.placed(wrapper.read(h)) if kind == "#")
    on = {p: sum(any(kind == "#" and place == p for kind, _, place in wrapper.placed(wrapper.read(h))) for k, _, h in rows if k < 20) for p, _ in by_place}
    assert [n < on[p] for (p, x), n in by_place.items() if "crumbs" in x] == [True]
    few = wrapper.wrappers(table.select("page_id", "url", "html"), 2).collect()  # rounds of two streams
    assert {r["host"] for r in few} == {"plain.example", "pair.example"} and len(few) == 2


def test_wrapper_odd_pages(spark):
    deep = "<div>" * 20_000 + "deep"
    many = "".join(f"<h{1 + k * k % 5}>{k}</h{1 + k * k % 5}>" for k in range(2000))
    rows = [(1, "http://o.example/", deep), (1, "http://o.example/", deep), (2, "http://o.example/", many), (3, "http://o.example/", ""), (None, "http://[", "<p>x")]
    schema = "page_id long, url string, html string"
    got = Counter((r["page_id"], r["text"][:9], r["n_chars"]) for r in wrapper.main_texts(spark.createDataFrame(rows, schema)).collect())
    assert got == Counter([(1, "deep", 4), (1, "deep", 4), (2, "0\n\n1\n\n2\n\n", sum(len(str(k)) for k in range(2000)) + 2 * 1999), (3, "", 0), (None, "x", 1)])
    assert wrapper.main_texts(spark.createDataFrame([], schema)).count() == 0


def test_wrapper_keeps_texts_where_pages_differ(spark):
    pairs = [("<h2>x</h2>", "<h3>y</h3>"), ("<ul><li>x</ul>", "<ol><li>y</ol>"), ("<p>x</p>", "<blockquote><p>y</p></blockquote>"), ("<p>x</p>", "<p>y</p><p>z</p>"), ("<p>x</p>", "<div>y</div><p>z</p><p>w</p>")]
    rows = [(2 * k + i, f"http://h{k}.example/{i}", f"<article><h1>t</h1>{x}</article>") for k, pair in enumerate(pairs) for i, x in enumerate(pair)]
    got = {r["page_id"]: r["text"] for r in wrapper.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = ["x", "y", "x", "y", "x", "y", "x", "y z", "x", "y z w"]
    assert got == {k: "\n\n".join(["t", *x.split()]) for k, x in enumerate(want)}


def test_pipeline(spark, docs, tmp_path):
    rows = docs.filter("doc_id is not null").select("doc_id", "text", "lang", "source", "n_chars")
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    d = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r for r in d.collect()}
        stage(spark, d, str(tmp_path)).write.parquet(str(tmp_path / name))
        d = spark.read.schema(d.schema).parquet(str(tmp_path / name))
        after = d.collect()
        assert d.columns == rows.columns and len(after) == len({r["doc_id"] for r in after}) and {r["doc_id"] for r in after} <= set(before)
        if name == "simhash_near_dedup":
            fps = [simhash.fingerprint((r["text"] or "").encode()) for r in after]
            assert all((a ^ b).bit_count() > 3 for i, a in enumerate(fps) for b in fps[:i])
        if name == "suffix_array_dedup":
            want = brute_repeats([(k, (r["text"] or "").encode()) for k, r in before.items()])
            assert {r["doc_id"]: r["text"] for r in after} == {k: v[3].decode("utf-8", "ignore") if v[1] else before[k]["text"] for k, v in want.items()}
    packed = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert set(packed.doc_id) == {r["doc_id"] for r in d.collect()}


def test_pipeline_on_an_empty_table_and_without_labels(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, extra string"
    for name, rows in (("none", []), ("odd", [(None, None, None, None, None, None), (1, "", "en", "s", 0, "x"), (1, "", "en", "s", 0, "x")])):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / name / "labels.parquet"))
        assert corpus_pipeline.run(spark, str(tmp_path / name)).count() == 0
        d = spark.read.parquet(str(tmp_path / name / "documents.parquet"))
        for stage in (toxicity.nontoxic(d, spark.read.parquet(str(tmp_path / name / "labels.parquet"))), simhash.leaders(d), suffix.cut(d)):
            assert stage.columns == d.columns
            assert stage.count() <= len(rows)


def plain_rows(n=4, words=90):
    rng = random.Random(8)
    return [(i, " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(words)), "en", "s", 0) for i in range(n)]


def test_repeated_rows_keep_one_text(spark):
    a, b, *_ = plain_rows()
    d = spark.createDataFrame([a, b, a, a], "doc_id long, text string, lang string, source string, n_chars long")
    kept = simhash.leaders(d)
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == [a[:2], b[:2]]
    assert sorted((r["doc_id"], r["text"]) for r in suffix.cut(kept).collect()) == [a[:2], b[:2]]
    assert sorted(r["doc_id"] for r in suffix.cut(d).collect()) == [0, 0, 0, 1]


def test_null_ids_stay(spark):
    a, b, c, e = plain_rows()
    a, c, same = (None, *a[1:]), (2, a[1][:300] + " " + c[1], *c[2:]), (None, *e[1:])
    d = spark.createDataFrame([a, b, c, same, same], "doc_id long, text string, lang string, source string, n_chars long")
    kept = quality.kept(d)
    assert kept.count() == 5
    led = simhash.leaders(kept)
    assert sorted(str(r["doc_id"]) for r in led.collect()) == ["1", "2", "None", "None"]
    rest = {(r["doc_id"], r["text"]) for r in suffix.cut(led).collect()}
    assert rest == {(None, a[1][301:]), (1, b[1]), (2, c[1][301:]), (None, e[1])}
    assert sorted(r["n_removed"] for r in suffix.without_repeats(led).collect()) == [0, 0, 301, 301]


@pytest.mark.parametrize("group", [2, simhash.GROUP])
def test_near_copies_of_five_word_shingles_go(spark, group):
    rng = random.Random(4)
    rows = []
    for g in range(30):
        words = rng.choices([f"w{k}" for k in range(5000)], k=100)
        for c in range(5):  # similar to the first at 0.8 or more
            near = words[:]
            for k in rng.sample((10, 40, 70), c and 1 + c % 2):
                near[k] = f"new{c}"
            rows.append((5 * g + c, " ".join(near)))
        rows.append((1000 + g, " ".join(words[:50] + rng.choices(words, k=50))))
    sets = {k: simhash.shingles(t) for k, t in rows}
    home = {k: k for k in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                old, new = max(home[a], home[b]), min(home[a], home[b])
                home = {k: new if v == old else v for k, v in home.items()}
    got = {r["doc_id"] for r in simhash.leaders(spark.createDataFrame(rows, "doc_id long, text string"), group).collect()}
    assert got == set(home.values()) and len(got) == 60


@pytest.fixture(scope="module")
def tables_of_sf():
    con = duckdb.connect()
    for name in ("documents", "labels", "embeddings", "pages", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_equal_their_sql(spark, tables_of_sf, name):
    got, want = queries.QUERIES[name](spark, SF).toPandas(), tables_of_sf.execute(queries.ORACLE_SQL[name]).df()
    cols = sorted(want.columns)
    got, want = (x[cols].sort_values(cols).reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


def test_queries_without_sql_equal_brute_force(spark, tables_of_sf):
    docs = [(i, t or "") for i, t in tables_of_sf.execute("SELECT doc_id, text FROM documents").fetchall()]
    run = lambda name: queries.QUERIES[name](spark, SF).collect()

    got = {r["doc_id"]: r for r in run("op3_toxicity")}
    assert set(got) == {i for i, _ in docs} and len(got) == len(docs)
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for i, r in got.items())
    toxic = dict(tables_of_sf.execute("SELECT doc_id, toxic FROM labels").fetchall())
    assert np.mean([got[i]["predicted"] == y for i, y in toxic.items()]) > 0.9

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(packing.tokenizer_path())
    ids = {i: [*library.encode(t, add_special_tokens=False).ids, 0] for i, t in docs}
    packed = run("op5_best_fit_packing")
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in packed} == {
        (i, p): (at, len(part := x[at : at + 2048]), zlib.crc32(np.array(part, "<u4").tobytes())) for i, x in ids.items() for p, at in enumerate(range(0, len(x), 2048))
    }
    by = defaultdict(list)
    for r in packed:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    assert all([o for o, _ in sorted(x)] == [0, *np.cumsum([n for _, n in sorted(x)])[:-1]] and sum(n for _, n in x) <= 2048 for x in by.values())
    assert len(by) <= 1.01 * -(-sum(map(len, ids.values())) // 2048) + 1

    fps = {i: simhash.fingerprint(t.encode()) for i, t in docs}
    home = {i: i for i in fps}
    for a in sorted(fps):
        for b in sorted(fps):
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 3 and home[a] != home[b]:
                old, new = max(home[a], home[b]), min(home[a], home[b])
                home = {k: new if v == old else v for k, v in home.items()}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in run("op6_simhash")} == {i: (f"{fps[i]:016x}", home[i]) for i in fps}

    assert all(r["restored"] for r in run("op7_sentencepiece"))

    want = brute_repeats([(i, t.encode()) for i, t in docs])
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in run("op8_suffix_array")} == {i: (*v[:3], hashlib.sha256(v[3]).hexdigest()) for i, v in want.items()}

    pages = [(i, u, h or "") for i, u, h in tables_of_sf.execute("SELECT page_id, url, html FROM pages").fetchall()]
    lead = {}
    for i, _, h in pages:
        lead[h] = max(i, lead.get(h, i))
    assert {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in run("op9_warc")} == {
        i: (len(h.encode()), warc.digest(h.encode()), *(("response", None) if lead[h] == i else ("revisit", lead[h]))) for i, _, h in pages
    }
    texts = {r["page_id"]: r for r in run("op10_html_wrapper")}
    assert len(texts) == len(pages) and all(texts[i]["url"] == u and texts[i]["n_chars"] == len(texts[i]["text"]) for i, u, _ in pages)
    assert not any(x in r["text"] for r in texts.values() for x in ("<p>", "</", "&amp;", "track("))


def test_registered():
    assert [q.split("_")[0] for q in queries.QUERIES] == [f"op{i}" for i in range(1, 11)]


def test_buffers():
    data = [b"", b"abc", b"d"]
    flat, offsets = chat.utf8(pa.array(data, pa.binary()).slice(1))
    assert flat.tobytes() == b"abcd" and offsets.tolist() == [0, 3, 4]


def test_hot_join_splits_a_hot_key_and_loses_nothing(spark):
    from pyspark.sql import functions as F

    from corpusloom.llm.common import SALTS, hot_join

    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 50).alias("key"))
    by_key = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    got = hot_join(rows, by_key, "key", "n", 3000)
    assert sorted(got.columns) == ["id", "key", "least", "n"]
    want = rows.join(by_key, "key").select(got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert by_key.filter(F.col("n") > max(3000 // 1000, SALTS)).count() == 1
    assert hot_join(rows.limit(0), by_key.limit(0), "key", "n", 0).count() == 0


def test_a_stage_begins_with_a_collection_in_the_executors(spark):
    from corpusloom.llm.common import scope

    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans
    full = lambda: sum(b.getCollectionCount() for b in beans() if "Old" in b.getName() or "MarkSweep" in b.getName())
    before = full()
    with scope(spark, "collected"):
        assert full() - before >= 2  # the driver's own, and that of the tasks, which have the same JVM here
