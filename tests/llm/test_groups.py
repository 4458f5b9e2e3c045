"""Operators over groups of rows, against brute force."""

import collections
import gzip
import json
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tallyhouse.llm import cascade, decontaminate, jaccard, warc
from tallyhouse.llm.components import stars
from tallyhouse.llm.hashing import word_hashes

DOCS = "doc_id long, text string, lang string, doc string, component string, print string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture
def docs(spark):
    def make(texts, ids=None):
        ids = range(len(texts)) if ids is None else ids
        return spark.createDataFrame([(i, t, *[None] * 4) for i, t in zip(ids, texts)], DOCS)

    return make


def groups(texts):
    """Component ids by comparing every pair."""
    sets = []
    for text in texts:
        w = (text or "").translate(LOWER).encode().split()
        sets.append(set(zip(*(w[k:] for k in range(5)))) if len(w) >= 5 else {tuple(w)} if w else set())
    least = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = least[i], least[j]
                least = [min(a, b) if x in (a, b) else x for x in least]
    return {i: (len(s), least[i]) for i, s in enumerate(sets)}


def edited(words, rnd, n):
    words = list(words)
    for _ in range(n):
        words[rnd.randrange(len(words))] = f"e{rnd.randrange(10**6)}"
    return words


def corpus(seed):
    rnd = random.Random(seed)
    base = [f"w{rnd.randrange(400)}" for _ in range(120)]
    passage = " ".join(f"common{i}" for i in range(55))
    texts = [" ".join(base)] * 3
    texts += [" ".join(edited(base, rnd, rnd.randint(1, 4))) for _ in range(40)]
    texts += [" ".join(f"r{rnd.randrange(10**6)}" for _ in range(rnd.randint(1, 80))) for _ in range(30)]
    texts += [f"{passage} " + " ".join(f"q{rnd.randrange(10**6)}" for _ in range(rnd.randint(5, 20))) for _ in range(20)]
    texts += [None, "", " \n", "a b", "A  b", "a b c", "x y z t u", "x y z t u v"]
    rnd.shuffle(texts)
    return texts


class TestJaccard:
    @pytest.mark.parametrize("most", [2048, 5, 1])
    def test_brute_force(self, docs, most):
        texts = corpus(most)
        got = {r.doc: (r.n_shingles, r.component) for r in jaccard.components(docs(texts), most=most).collect()}
        assert got == groups(texts)

    def test_many_chunks_and_frequent_shingles(self, docs, monkeypatch):
        texts = corpus(9)
        monkeypatch.setattr(jaccard, "CHUNK", 300)
        monkeypatch.setattr(jaccard, "OFTEN", 2)
        got = {r.doc: (r.n_shingles, r.component) for r in jaccard.components(docs(texts)).collect()}
        assert got == groups(texts)

    def test_exactly_the_threshold(self, docs):
        # 9 and 8 of 10 shingles: 8 shared of 10 links, 7 of 10 does not.
        w = [f"w{i}" for i in range(14)]
        links = [" ".join(w[:13]), " ".join(w[1:])]  # 9 and 9 shingles, 8 shared, union 10
        apart = [" ".join(f"v{i}" for i in range(12)), " ".join(f"v{i}" for i in range(2, 14))]
        got = {r.doc: r.component for r in jaccard.components(docs(links + apart)).collect()}
        assert got == {0: 0, 1: 0, 2: 2, 3: 3}

    def test_null_and_repeated_ids(self, docs):
        text = "one two three four five six"
        rows = jaccard.components(docs([text, text, text, None], [None, 7, 7, None])).collect()
        assert sorted((str(r.doc), str(r.component)) for r in rows) == [("7", "7"), ("7", "7"), ("None", "7"), ("None", "None")]

    def test_keep_one(self, docs):
        texts = corpus(4)
        kept = jaccard.keep_one(docs(texts))
        assert kept.columns == docs([]).columns
        assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in groups(texts).values()})

    def test_empty(self, docs):
        assert jaccard.components(docs([])).count() == 0

    def test_long_text_in_pieces(self):
        words = [f"word{i}" for i in range(200_000)]
        text = " ".join(words).encode()
        assert len(text) > 1 << 20
        assert word_hashes(text).tolist() == [int(word_hashes(w.encode())[0]) for w in words[:500]] + word_hashes(text).tolist()[500:]
        assert len(word_hashes(text)) == len(words)
        assert word_hashes(b"ABC\x0bd") .tolist() == word_hashes(b" abc d ").tolist()


def test_components_of_paths_and_stars(spark):
    rnd = random.Random(3)
    path = [(f"p{i:03}", f"p{i + 1:03}") for i in range(60)]
    star = [("s0", f"s{i}") for i in range(1, 30)]
    edges = path + star + [("x", "x")]
    rnd.shuffle(edges)
    got = {r.node: r.root for r in stars(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {f"p{i:03}": "p000" for i in range(1, 61)} | {f"s{i}": "s0" for i in range(1, 30)}
    assert stars(spark.createDataFrame([], "a string, b string")).count() == 0


class TestWarc:
    PAGES = "page_id long, url string, html string, id string, payload string, digest string"

    def pages(self, spark, rows):
        return spark.createDataFrame([(*r, None, None, None) for r in rows], self.PAGES)

    def test_round_trip(self, spark):
        long_ = "é" * 60
        rows = [(5, "http://a/\r\nX: y", long_), (2, "u", long_), (9, None, long_), (1, "u", "short"), (0, "u", "short"), (3, "", None), (4, "u", "a\r\n\r\nb" * 40), (None, "u", long_), (7, "u", "z" * 300_000)]
        listing = warc.write_archives(self.pages(spark, rows), roll=500)
        index = warc.normalise(listing)
        got = {r.page: r for r in warc.read_records(index).collect()}
        assert len(got) == len(rows)
        for page, _, html in rows:
            payload, r = (html or "").encode(), got[page]
            assert r.payload_bytes == len(payload)
            assert r.refers_to == (2 if html == long_ and page != 2 else None)
            assert r.record_type == ("revisit" if r.refers_to else "response")
            if r.record_type == "response":
                assert r.payload == payload
        assert sum(r.records for r in listing.collect()) == len(rows)

    def test_files(self, spark):
        rows = [(i, f"http://x/{i}", f"page {i} " * 30) for i in range(20)]
        listing = warc.write_archives(self.pages(spark, rows))
        for r in listing.collect():  # one stream: nothing is left after the first member
            data = open(r.archive.removeprefix("file:"), "rb").read()
            inflate = zlib.decompressobj(31)
            assert inflate.decompress(data).count(b"WARC/1.1\r\n") == r.records
            assert inflate.eof and not inflate.unused_data
        index = warc.normalise(listing).collect()
        for r in index:
            data = open(r.archive.removeprefix("file:"), "rb").read()[r.offset : r.offset + r.length]
            assert gzip.decompress(data).startswith(b"WARC/1.1\r\nWARC-Type: response")
        path = index[0].archive.removeprefix("file:")
        sidecar = [json.loads(x) for x in open(f"{path}.idx")]
        assert [s["offset"] for s in sidecar] == sorted(r.offset for r in index if r.archive == index[0].archive)

    def test_archives_are_spread_over_tasks(self, spark, monkeypatch):
        """Rewriting and reading are many tasks, and index entries leave in slices."""
        monkeypatch.setattr(warc, "ENTRIES", 3)
        monkeypatch.setattr(warc, "READ_BYTES", 1000)
        rows = [(i, "http://a/", f"page {i} " + "x" * 300) for i in range(200)]
        listing = warc.write_archives(self.pages(spark, rows).repartition(8), roll=1500)
        assert listing.count() >= 20
        dealt = warc.dealt_out(listing.select("archive"), listing.count(), "archive")
        sizes = [n for n in dealt.rdd.glom().map(len).collect() if n]
        assert max(sizes) == 1 and len(sizes) == listing.count()
        index = warc.normalise(listing)
        assert index.count() == 200
        assert len(index.inputFiles()) >= 20
        back = warc.read_records(index)
        assert sorted(r.page for r in back.collect()) == list(range(200))

    def test_empty(self, spark):
        index = warc.normalise(warc.write_archives(self.pages(spark, [])))
        assert warc.read_records(index).count() == 0


class TestCascade:
    def keys(self, spark, values):
        return spark.createDataFrame([(v,) for v in values], "key string")

    @pytest.mark.parametrize("n", [0, 1, 40, 700])
    def test_exact_over_the_universe(self, spark, n):
        universe = [f"k{i}" for i in range(1500)]
        listed = [f"k{i * 2}" for i in range(n)] + (["elsewhere"] if n else [])
        made = cascade.Cascade(self.keys(spark, universe), self.keys(spark, listed))
        frame = self.keys(spark, [*universe, None])
        got = {r.key for r in frame.filter(made.holds(frame["key"])).collect()}
        assert got == set(universe) & set(listed)

    def test_size_is_bounded(self, spark):
        with pytest.raises(ValueError, match="bytes"):
            cascade.Cascade(self.keys(spark, ["a"]), self.keys(spark, map(str, range(500))), max_bytes=8)

    def test_rules(self, spark):
        urls = ["http://A.NET/x", "http://net", "net/", None, "", "x://example.net/en/", "x://example.net/en", "x://w.example.net/en/a?b", "x://notexample.com/de/", "x://w.example.com/de/", "x://org/fr/", "x://a.org#/fr/", "x://net./", "a://b://net/", "://net/"]
        pages = spark.createDataFrame([(i, u, None, None) for i, u in enumerate(urls)], "page_id long, url string, rule string, host string")
        from tallyhouse.llm.queries import URL_RULES

        got = {r.id: r for r in cascade.judge(pages, URL_RULES).collect()}
        rules = {i: got[i].rule for i in got if got[i].rule}
        assert rules == {0: "net/", 5: "example.net/en/", 6: "net/", 7: "example.net/en/", 9: "example.com/de/", 10: "org/fr/", 14: "net/"}
        assert got[0].verdict == "block" and got[7].verdict == "allow" and got[1].verdict == "allow"
        assert (got[0].host, got[0].path) == ("a.net", "/x")
        assert (got[3].host, got[3].path, got[2].host) == ("", "", "")
        assert (got[13].host, got[13].path) == ("b:", "//net/")
        assert cascade.judge(pages.limit(0), URL_RULES).count() == 0
        assert {r.verdict for r in cascade.judge(pages, ()).collect()} == {"allow"}


class TestDecontaminate:
    def benchmark(self, spark, rows):
        return spark.createDataFrame(rows, "item_id long, text string, answer string")

    def test_planted_passages(self, spark, docs):
        rnd = random.Random(5)

        def words(n):
            return [rnd.choice(["the", "of", "and"]) if rnd.random() < 0.4 else f"t{rnd.randrange(20000)}" for _ in range(n)]

        items = [words(rnd.choice([16, 30, 55, 90])) for _ in range(30)]
        texts, planted = [], {}
        for i in range(200):
            text = words(rnd.randint(20, 900))
            if i % 4 == 0:
                item = rnd.randrange(30)
                own = list(items[item])
                if i % 8 == 0:  # paraphrased: every eighth word is another one
                    own[::8] = [f"other{k}" for k in range(len(own[::8]))]
                at = rnd.randrange(len(text))
                text[at:at] = own
                planted[i] = item
            texts.append(" ".join(text))
        bench = self.benchmark(spark, [(i, " ".join(w), None) for i, w in enumerate(items)])
        got = {(r.doc, r.item) for r in decontaminate.leaks(docs(texts), bench).collect()}
        assert got == set(planted.items())

    def test_every_pair_by_brute_force(self, spark):
        """The query flags what the alignment alone flags, without the latent search."""
        from tallyhouse.llm import queries

        sf_dir = "/root/testdata/sf0.001"
        got = {(r.doc_id, r.item_id) for r in queries.op9_benchmark_decontamination(spark, sf_dir).collect()}
        bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()
        verbatim = set()
        for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
            text = " " + " ".join(r.text.lower().split()) + " "
            verbatim |= {(r.doc_id, b.item_id) for b in bench if f" {' '.join(b.text.lower().split())} " in text}
        assert verbatim and verbatim <= got
        rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
        pairs = aligned_pairs([r.text for r in rows], [(b.item_id, b.text) for b in bench])
        alone = {(rows[doc].doc_id, item) for doc, item in pairs}
        assert got <= alone and len(got) >= 0.9 * len(alone)

    def test_long_items(self, spark, docs):
        rnd = random.Random(8)
        items = [[f"t{rnd.randrange(5000)}" for _ in range(n)] for n in (300, 1000, 65, 500)]
        texts, planted = [], set()
        for i in range(60):
            text = [f"t{rnd.randrange(5000)}" for _ in range(rnd.randint(20, 600))]
            if i % 3:
                item = i % 4
                own = list(items[item])
                if i % 3 == 2:  # paraphrased: every fourth word is another one
                    own[::4] = [f"other{k}" for k in range(len(own[::4]))]
                at = rnd.randrange(len(text))
                text[at:at] = own
                planted.add((i, item))
            texts.append(" ".join(text))
        bench = self.benchmark(spark, [(i, " ".join(w), None) for i, w in enumerate(items)])
        assert {(r.doc, r.item) for r in decontaminate.leaks(docs(texts), bench).collect()} == planted

    def test_odd_rows(self, spark, docs):
        item = " ".join(f"i{k}" for k in range(20))
        bench = self.benchmark(spark, [(None, item, None), (1, None, None), (2, " ", None), (3, "", "x")])
        texts = [None, "", item, f"{'long ' * 100_000}{item}", item]
        rows = decontaminate.leaks(docs(texts, [0, 1, None, 3, 3]), bench, answer_col="answer").collect()
        assert collections.Counter((r.doc, r.item) for r in rows) == {(None, None): 1, (3, None): 2}
        kept = decontaminate.clean(docs(texts, [0, 1, None, 3, 3]), bench.drop("answer"))
        assert sorted(r.doc_id for r in kept.collect()) == [0, 1]

    def test_short_texts_are_numbered_together(self, monkeypatch):
        """One call for many short texts, with the numbers that each has by itself."""
        from tallyhouse.llm import hashing

        (items,) = decontaminate.items_of([(0, "a b c état", None), (1, "c d", None)])
        texts = ["A b x", None, "", " \n c\x0bd ", "état", "b " * 70_000, "a", "d " * 600_000, "c", *["x a b"] * 500]
        alone = [items.numbers(hashing.word_hashes((t or "").encode())).tolist() for t in texts]
        calls, plain = [], hashing.mix
        monkeypatch.setattr(hashing, "mix", lambda x: calls.append(1) or plain(x))
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], ["doc", "text"])
        got = list(items.numbered(batch))
        assert [n.tolist() for _, _, n in got] == alone and len(calls) < 10
        assert [(key, text) for key, text, _ in got] == [(i, (t or "").encode()) for i, t in enumerate(texts)]
        for numbers in alone[:5]:
            assert items.distinct(np.array(numbers, dtype=np.int64)).tolist() == sorted({*numbers} - {-1})

    def test_empty(self, spark, docs):
        bench = self.benchmark(spark, [(1, "a b c", None)])
        assert decontaminate.leaks(docs([]), bench).count() == 0
        assert decontaminate.leaks(docs(["a b c"]), bench.limit(0)).count() == 0


def aligned_pairs(texts, bench):
    """All pairs by the alignment alone: no windows, no latent space, no prefilter."""
    from tallyhouse.llm.hashing import word_hashes

    (items,) = decontaminate.items_of([(i, t, None) for i, t in bench])
    numbers = [items.numbers(word_hashes(t.encode())) for t in texts]
    df = np.zeros(len(items.known))
    for n in numbers:
        df[np.unique(n[n >= 0])] += 1
    idf = np.log((1 + len(texts)) / (1 + df)) + 0.01
    space = decontaminate.Space(items, idf, np.zeros((len(idf), 0)), 0.6, 0.8)
    out = set()
    for doc, n in enumerate(numbers):
        for item, words in enumerate(items.words):
            step = len(words)
            for a in range(0, max(1, len(n)), step):
                if space._aligned(item, n[max(0, a - step) : a + 2 * step]):
                    out.add((doc, items.ids[item]))
    return out


class TestDecontaminationByAlignment:
    def test_short_items_in_texts_of_their_own_words(self, spark):
        """250 words in all, 250 items of 6 to 40 words, copied into texts of the same words."""
        draw = np.random.default_rng(11)
        words = [f"w{i}" for i in range(250)]
        bench = [(i, " ".join(draw.choice(words, size=int(draw.choice([6, 10, 16, 33, 40]))))) for i in range(250)]
        texts, planted = [], set()
        for doc in range(125):
            text = draw.choice(words, size=300).tolist()
            item = doc * 2
            at = int(draw.integers(0, 300))
            texts.append(" ".join([*text[:at], bench[item][1], *text[at:]]))
            planted.add((doc, item))
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        items = spark.createDataFrame(bench, "item_id long, text string")
        got = {(r.doc, r.item) for r in decontaminate.leaks(docs, items).collect()}
        want = aligned_pairs(texts, bench)
        assert planted <= got
        assert len(got & want) >= 0.9 * len(want)

    def test_equal_items_are_searched_once_and_all_named(self, spark):
        text = " ".join(f"word{i}" for i in range(30))
        docs = spark.createDataFrame([(1, f"before {text} after"), (1, f"before {text} after"), (2, "other")], "doc_id long, text string")
        items = spark.createDataFrame([(i, text) for i in range(500)] + [(None, text)], "item_id long, text string")
        got = decontaminate.leaks(docs, items).collect()
        assert len(got) == 2 * 501 and {r.doc for r in got} == {1}

    def test_a_very_long_item(self, spark):
        """100,000 words: their segments are several blocks, their copy one hit per row."""
        draw = np.random.default_rng(2)
        long = " ".join(f"v{i}" for i in draw.integers(0, 30_000, size=100_000))
        groups = decontaminate.items_of([(1, long, None)])
        assert len(groups) > 1 and all(len(g.parts) <= 2 * decontaminate.BLOCK for g in groups)
        assert sum(len(p) for g in groups for _, p in g.parts) == 100_000
        # The whole path on an item of more than one block, in smaller blocks.
        text = " ".join(f"v{i}" for i in draw.integers(0, 800, size=1200))
        docs = spark.createDataFrame([(1, f"a b {text} c"), (1, f"a b {text} c"), (2, text[:200])], "doc_id long, text string")
        items = spark.createDataFrame([(7, text), (8, "nothing like it at all")], "item_id long, text string")
        before = decontaminate.BLOCK
        decontaminate.BLOCK = 4
        try:
            got = decontaminate.leaks(docs, items).collect()
        finally:
            decontaminate.BLOCK = before
        assert [(r.doc, r.item) for r in got] == [(1, 7), (1, 7)]
