import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyfold.llm import leaks
from skyfold.llm.leaks import edit_distances, find_leaks, words_of
from skyfold.llm.packing import hilbert_keys, pack
from skyfold.llm import queries as Q
from skyfold.llm import splitting
from skyfold.llm.splitting import split_texts
from skyfold.llm.tokens import tokenizer

WORDS = "orbit lens seal crate quick valve paper stone river cloud metal grain horse table light sound wheel plant glass chair".split()


def text(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", ".", ",", "\n", ""]) for _ in range(n))


def test_hilbert_neighbours_touch():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        keys = hilbert_keys(grid, bits)
        assert sorted(keys) == list(range(len(grid)))
        walk = grid[np.argsort(keys)]
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_packing_keeps_texts_whole(spark):
    rng = random.Random(2)
    rows = [(i, text(rng, rng.choice([1, 5, 40, 90, 700]))) for i in range(400)] + [(500, ""), (501, None), (None, "lone"), (7, "seven again")] + [(600 + i, "the same text here") for i in range(300)]
    df = spark.createDataFrame(rows, "id long, text string").withColumn("container", F.lit("x"))
    got = pack(df, "id", "text", 256, task_tokens=20_000).collect()
    tok = tokenizer()
    size = sum(len(tok.encode(t or "")) for _, t in rows)
    used, pieces = defaultdict(int), defaultdict(list)
    for r in got:
        used[r.container] += r.n_tokens
        pieces[r.id].append((r.piece, r.token_from, r.n_tokens))
    assert max(used.values()) <= 256 and sum(used.values()) == size
    assert size / (256 * len(used)) > 0.97
    assert set(pieces) == {r[0] for r in rows} and len(pieces[7]) >= 2
    n = len(tok.encode(rows[3][1]))
    for i, t in rows[:400]:
        if i != 7:
            n = len(tok.encode(t))
            assert sorted(pieces[i]) == [(k, k * 256, min(256, n - k * 256)) for k in range(max(1, -(-n // 256)))]
    assert pack(df.limit(0), "id", "text", 256).count() == 0


def test_any_number_of_empty_texts_shares_a_container(spark):
    rows = [(i, "" if i % 2 else None) for i in range(3000)]
    for more in ([], [(9000 + i, "some words of a text " * (1 + i % 7)) for i in range(60)]):
        got = pack(spark.createDataFrame(rows + more, "id long, text string"), "id", "text", 64).collect()
        assert len(got) == len(rows) + len(more) + sum(r.piece > 0 for r in got)
        used = defaultdict(int)
        for r in got:
            used[r.container] += r.n_tokens
        assert max(used.values()) <= 64 and len({r.container for r in got if r.n_tokens == 0}) == 1
        assert len(used) <= max(1, -(-sum(used.values()) // 64) + 1)


def plain_edits(p, t):
    row = [0] * (len(t) + 1)
    for i, a in enumerate(p):
        new = [i + 1]
        for j, b in enumerate(t):
            new.append(min(row[j] + (a != b), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_bit_vectors_equal_the_edit_table():
    rng = np.random.default_rng(1)
    for m, width in ((12, 16), (5, 9), (64, 70)):
        p, t = rng.integers(1, 4, (200, m)), rng.integers(1, 4, (200, width))
        n = rng.integers(0, width + 1, 200)
        assert edit_distances(p, t, n).tolist() == [plain_edits(list(a), list(b[:k])) for a, b, k in zip(p, t, n)]


def test_words():
    assert words_of("A<b class='x'>B</b> &amp; café_No­te ﬁx a < b > c &lt;i&gt;") == ["a", "b", "café", "note", "fix", "a", "b", "c", "i"]


def plain_words(t):
    import html
    import re
    import unicodedata

    t = html.unescape(re.sub(r"</?[^\W\d_][^<>]*>", " ", t))
    t = unicodedata.normalize("NFKC", "".join(c for c in t if unicodedata.category(c) != "Cf")).lower()
    return "".join(c if c.isalnum() else " " for c in t).split()


def test_words_of_whole_tables(spark, sf):
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect():
        if r.text:
            assert words_of(r.text) == [w for w in plain_words(r.text)]


def test_bitmaps_cover_the_words_around():
    rng = np.random.default_rng(2)
    per = np.array([0, 1, 5, 40, 0, 3])
    h = rng.integers(0, 1 << 63, per.sum(), dtype=np.int64).astype(np.uint64) * np.uint64(2)
    n = np.maximum(per - 2, 0)
    got, k = leaks._bitmaps(h, per, 5, 9, n), 0
    for a, size, m in zip(np.cumsum(per) - per, per, n):
        for i in range(m):
            around = h[a + max(i - 5, 0) : a + min(i + 9, size)]
            assert got[k] == np.bitwise_or.reduce(np.uint64(1) << (around >> np.uint64(58)))
            k += 1
    assert k == len(got)


def test_found_leaks_of_whole_tables(spark, sf):
    """p9_found against a search for all runs of twelve words, on the smallest tables as a whole."""
    runs = defaultdict(set)
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = plain_words(r.text or "")
        for k in range(len(w) - 11):
            runs[tuple(w[k : k + 12])].add(r.item_id)
    want = set()
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        w = plain_words(r.text or "")
        want |= {(r.doc_id, i) for k in range(len(w) - 11) for i in runs.get(tuple(w[k : k + 12]), ())}
    assert {tuple(r) for r in Q.QUERIES["p9_found"](spark, sf).select("doc_id", "item_id").collect()} == want and want


@pytest.mark.parametrize("edits", [1, 2])
def test_edited_passages_are_found(spark, sf, edits):
    """Passages of the benchmark with one or two word edits, planted in documents: recall is 1, as the pigeonhole promises."""
    rng = random.Random(edits)
    items = [(r.item_id, words_of(r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() if r.text and len(words_of(r.text)) >= 12]
    docs = [words_of(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect() if r.text]
    planted, want = [], set()
    for n in range(200):
        item, w = items[n % len(items)]
        k = rng.randrange(len(w) - 11)
        run = w[k : k + 12]
        for _ in range(edits):
            j = rng.randrange(len(run))
            run[j : j + 1] = rng.choice([[], ["zzq"], ["zzq", run[j]]])
        body = docs[n % len(docs)]
        at = rng.randrange(len(body) + 1)
        planted.append((n, " ".join(body[:at] + run + body[at:])))
        want.add((n, item))
    got = {(r.n, r.item_id): r.edits for r in find_leaks(spark.createDataFrame(planted, "n long, text string"), spark.read.parquet(f"{sf}/benchmark.parquet"), "n", "item_id").collect()}
    assert want <= set(got) and all(got[x] <= edits for x in want)


def test_leaks_match_brute_force(spark):
    rng = random.Random(4)
    items = [(i, text(rng, 30)) for i in range(12)] + [(50, "too short"), (51, ""), (52, None), (None, text(rng, 20))]
    docs = []
    for i in range(150):
        words = text(rng, 60).split()
        src = words_of(items[i % 12][1])
        k = rng.randrange(0, 16)
        run = src[k : k + rng.choice([10, 11, 12, 13])]
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            j = rng.randrange(len(run))
            run[j : j + 1] = rng.choice([[], ["extra", "words"], ["zzz"]])
        at = rng.choice([0, 30, 60])
        docs.append((i, "<p>" + " ".join(words[:at] + run + words[at:]) + "</p>"))
    docs += [docs[0], (800, ""), (801, None), (None, items[0][1]), (900, " ".join(text(rng, 20000).split() + words_of(items[3][1])))]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("edits", F.lit("x"))
    b = spark.createDataFrame(items, "item_id long, text string")
    for budget in (0, 1, 2):
        got = {(r.doc_id, r.item_id): r.edits for r in find_leaks(d, b, "doc_id", "item_id", budget=budget).collect()}
        want = {}
        for i, t in set(docs[:-1]):
            for j, s in items[:12]:
                if i is not None and t:
                    w, p = words_of(t), words_of(s)
                    least = min(plain_edits(p[k : k + 12], w) for k in range(len(p) - 11)) if budget else 0 if any(p[k : k + 12] == w[m : m + 12] for k in range(len(p) - 11) for m in range(len(w))) else 9
                    if least <= budget:
                        want[i, j] = least
        assert got.pop((900, 3)) == 0
        assert {k: v for k, v in got.items() if k[0] != 900} == want and len(want) > 15
    assert find_leaks(d.limit(0), b, "doc_id", "item_id").count() == 0


@pytest.mark.parametrize("limit,overlap", [(64, 16), (100, 0)])
def test_pieces_cover_texts_within_the_limit(spark, limit, overlap):
    rng = random.Random(8)
    rows = [(i, text(rng, rng.choice([3, 80, 200, 900]))) for i in range(40)] + [(50, ""), (51, None), (None, text(rng, 300))]
    rows += [(60, "x" * 3000), (61, "漢字かな交じり文" * 120), (62, "🙂👩‍👩‍👧‍👦" * 90), (63, " \n\n " * 300 + "end"), (64, text(rng, 12000)), (65, text(rng, 300)), (65, text(rng, 310)), (1, rows[1][1])]
    df = spark.createDataFrame(rows, "id long, text string").withColumn("piece", F.lit("x"))
    got = defaultdict(list)
    for r in split_texts(df, "id", "text", limit, overlap).collect():
        got[r.id].append(r)
    tok = tokenizer()
    over = {i for i, t in rows if i is not None and t and len(tok.encode(t)) > limit}
    assert set(got) == over
    for i, t in rows:
        if i in over and i != 65:
            ids, at = tok.encode(t), 0
            for k, r in enumerate(sorted(got[i], key=lambda r: r.piece)):
                assert r.piece == k and r.n_tokens <= limit
                if k:
                    assert overlap <= at - r.token_from <= overlap + 3
                else:
                    assert r.token_from == 0
                part = ids[r.token_from : r.token_from + r.n_tokens].tolist()
                assert tok.encoding.decode_bytes(part).decode() == r.text
                at = r.token_from + r.n_tokens
            assert at == len(ids)
    assert len([r for r in got[65] if r.piece == 0]) == 2
    assert split_texts(df.limit(0), "id", "text", limit, overlap).count() == 0


def greedy_cuts(text, tok, limit, overlap):
    """Cut by cut, looking at every boundary of the text: the last natural one within reach, else word start, else token edge."""
    ids = tok.encode(text)
    data, ends, at = text.encode(), {0}, 0
    edge = []
    for i in ids:
        edge.append(at)
        at += int(tok.lengths[i])
    edge.append(at)
    lead = lambda b: b == len(data) or data[b] & 0xC0 != 0x80
    whole = [k for k, b in enumerate(edge) if lead(b)]
    chars = [len(text[: m.end()].encode()) for m in splitting._NATURAL.finditer(text)]
    natural = set()
    for b in chars:
        k = max(i for i, e in enumerate(edge) if e <= b) if len(edge) < 4000 else int(np.searchsorted(edge, b, "right")) - 1
        if lead(edge[k]) and not data[edge[k] : b].strip(b"\t\n\x0b\x0c\r "):
            natural.add(k)
    n = len(ids)
    natural = sorted({k for k in natural if overlap < k < n} | {n})
    words = [k for k in whole if overlap < k < n and data[edge[k]] in b" \n"]
    edges = [k for k in whole if overlap < k < n]
    cut, cuts = 0, []
    while cut < n:
        start = max(k for k in whole if k <= max(cut - overlap, 0))
        reach = start + limit
        cut = next(max(x) for x in ([k for k in group if cut < k <= reach] for group in (natural, words, edges)) if x)
        cuts.append((start, cut))
    return cuts


def test_pieces_of_whole_tables_equal_the_greedy_cuts(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    tok = tokenizer()
    table = spark.read.parquet(f"{sf}/documents.parquet")
    for limit, overlap, found in ((Q.PIECE, Q.OVERLAP, Q.QUERIES["p10_pieces"](spark, sf)), (48, 12, split_texts(table, "doc_id", "text", 48, 12))):
        got = defaultdict(list)
        for r in found.collect():
            got[r.doc_id].append((r.piece, r.token_from, r.token_from + r.n_tokens))
        want = {i: greedy_cuts(t, tok, limit, overlap) for i, t in docs.items() if t and len(tok.encode(t)) > limit}
        assert {i: [x[1:] for x in sorted(v)] for i, v in got.items()} == want and len(want) >= 10


def test_boundaries_listed_are_all_that_matter():
    """Odd texts, small limits: the listed boundaries give the same cuts as all boundaries."""
    rng = random.Random(5)
    tok = tokenizer()
    made = ["x" * 900, "漢字かな交じり文" * 80, "🙂👩‍👩‍👧‍👦" * 60, " \n\n " * 200 + "end", "a.b. c " * 150 + "z" * 500 + " tail. " * 40, text(rng, 500)]
    for t in made:
        for limit, overlap in ((64, 16), (40, 0), (30, 21)):
            pos, kind, _, start, _ = splitting.boundaries(t, tok, limit, overlap)
            cut, cuts = 0, []
            n = len(tok.encode(t))
            while cut < n:
                begin = int(start[list(pos).index(cut)])
                near = [k for k in (2, 1, 0) if ((pos > cut) & (pos <= begin + limit) & (kind == k)).any()][0]
                cut = int(pos[(pos > cut) & (pos <= begin + limit) & (kind == near)].max())
                cuts.append((begin, cut))
            assert cuts == greedy_cuts(t, tok, limit, overlap)
