"""Edge cases of the operators: nulls, empty and long texts, ties, repeats, no rows."""

import hashlib
import math

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tallyhouse.llm import chat, codec, lines, quality, token_counts, toxicity

PATH = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, id string, doc string, row string, t string, words long"
ODD = [None, "", " \t\n ", "a", "Ärger ärger", "x" * 300_000, "w " * 120_000, "<|endoftext|>a", "😀 \x0b b", "é" * 70_000]


@pytest.fixture
def docs(spark):
    """Texts with ids from 0; clashing columns are there and null."""

    def make(texts, ids=None):
        ids = range(len(texts)) if ids is None else ids
        rows = [(i, t, *[None] * 6) for i, t in zip(ids, texts)]
        return spark.createDataFrame(rows, DOCS)

    return make


def by_id(df, key="doc"):
    return {r[key]: r for r in df.collect()}


class TestQuality:
    def test_measures(self):
        text = "A bc  d\n\nA bc  d\nx A bc d #$".encode()
        words = 11
        assert quality.measure(text)[0] == words
        assert quality.measure(text)[2:5] == (2, 4, 1)

    def test_repeated_words_are_positions_in_repeated_windows(self):
        w = "a b c x a b c d".split()
        assert quality.repeated_words([x.encode() for x in w]) == 6
        assert quality.repeated_words([b"a"] * 5) == 5
        assert quality.repeated_words([b"a", b"b"]) == 0

    def test_odd_texts(self, docs):
        got = by_id(quality.apply_policy(quality.ledger(docs(ODD))), "doc_id")
        assert [got[i].n_words for i in range(4)] == [0, 0, 0, 1]
        assert not got[0].kept and got[0].fail_bits & 1
        assert got[5].word_chars == 300_000
        assert got[6].n_repeat_words == 120_000

    def test_null_and_repeated_ids(self, docs):
        rows = quality.ledger(docs(["a", "b", "b"], [None, 1, 1])).collect()
        assert sorted(str(r.doc_id) for r in rows) == ["1", "1", "None"]

    def test_keep_returns_all_columns_of_what_passes(self, docs):
        good = " ".join(f"word{i}" for i in range(60))
        kept = quality.keep(docs([good, "short", None]))
        assert kept.columns == docs([]).columns
        assert [r.doc_id for r in kept.collect()] == [0]

    def test_ablation(self, docs):
        good = " ".join(f"word{i}" for i in range(60))
        ledger = quality.ledger(docs([good, good + " # # # # # # # #", "a", "a #"]))
        cost = {(r.policy, r.rule): r for r in quality.ablation(ledger).collect()}
        assert cost["base-1", "too_few_words"].n_failed == 2
        assert cost["base-1", "too_few_words"].n_kept == 2
        assert cost["corpus-1", "symbols"].n_only == 1
        assert cost["corpus-1", "symbols"].with_bits & 1

    def test_empty(self, docs):
        assert quality.ledger(docs([])).count() == 0
        assert quality.ablation(quality.ledger(docs([]))).count() == 0


class TestLines:
    LONG = "This line has at least twenty characters"

    def test_stays_in_the_largest_id_only(self, docs):
        texts = [f"{self.LONG}\nown {i}" for i in range(3)] + [f"  {self.LONG.upper()}\t\n{self.LONG}"]
        got = by_id(lines.deduplicate(docs(texts)))
        assert [got[i].text for i in range(3)] == ["own 0", "own 1", "own 2"]
        assert got[3].text == texts[3] and got[3].n_dropped == 0

    def test_first(self, docs):
        got = by_id(lines.deduplicate(docs([self.LONG] * 3), keep="first"))
        assert [got[i].n_dropped for i in range(3)] == [0, 1, 1]

    def test_two_documents_and_short_keys_stay(self, docs):
        got = by_id(lines.deduplicate(docs([self.LONG, self.LONG, "short", "short", "short"])))
        assert all(r.n_dropped == 0 for r in got.values())

    def test_repeats_within_a_document_count_once(self, docs):
        got = by_id(lines.deduplicate(docs([f"{self.LONG}\n{self.LONG}", self.LONG])))
        assert got[0].n_dropped == 0

    def test_rows_of_one_id(self, docs):
        rows = lines.deduplicate(docs([self.LONG, self.LONG + "\nb", self.LONG, self.LONG], [1, 1, 2, 3]))
        assert sorted((r.doc, r.text, r.n_dropped) for r in rows.collect()) == [
            (1, "", 1), (1, "b", 1), (2, "", 1), (3, self.LONG, 0),
        ]

    def test_null_id_gives_way(self, docs):
        rows = lines.deduplicate(docs([self.LONG] * 3, [None, 1, 2])).collect()
        assert {r.doc: r.n_dropped for r in rows} == {None: 1, 1: 1, 2: 0}

    def test_odd_texts(self, docs):
        got = by_id(lines.deduplicate(docs(ODD)))
        assert (got[0].text, got[0].n_lines) == ("", 1)
        assert got[2].n_lines == 2 and got[5].text == ODD[5]

    def test_many_lines_need_many_words(self, docs):
        text = "\n".join(f"{self.LONG} {i}" for i in range(500))
        bitmaps = {r.doc: r for r in lines.drop_bitmaps(docs([text, text + "\nx", text])).collect()}
        assert bitmaps[0].n_dropped == 500 and len(bitmaps[0].words) == 8
        got = by_id(lines.deduplicate(docs([text, text + "\nx", text])))
        assert (got[0].text, got[1].text, got[2].text) == ("", "x", text)

    def test_rewrite_keeps_columns(self, docs):
        done = lines.rewrite(docs([self.LONG, self.LONG, self.LONG, None]))
        assert done.columns == docs([]).columns
        assert {r.doc_id: r.text for r in done.collect()} == {0: "", 1: "", 2: self.LONG, 3: None}

    def test_empty(self, docs):
        assert lines.deduplicate(docs([])).count() == 0


class TestTokens:
    @pytest.fixture
    def library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(PATH)

    def want(self, library, texts):
        return [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]

    TEXTS = [*ODD, "don't WE'LL 123 ΑΣ.Σ ﬁ ñ n\u0303", "<|startoftext|><|endoftext|>", "中文字 \u1c89\u2cf5", "a" * 3000 + " b"]

    @pytest.mark.parametrize("chunk", [1 << 16, 1000])
    def test_counts(self, docs, library, chunk):
        got = by_id(token_counts.count_tokens(docs(self.TEXTS), PATH, chunk_chars=chunk))
        assert [got[i].n_tokens for i in range(len(self.TEXTS))] == [len(x) for x in self.want(library, self.TEXTS)]
        assert [got[i].n_bytes for i in range(len(self.TEXTS))] == [len((t or "").encode()) for t in self.TEXTS]

    def test_ids_and_text(self, docs, library):
        ids = self.want(library, self.TEXTS)
        coded = codec.encode(docs(self.TEXTS), PATH)
        got = by_id(coded)
        assert [got[i].ids for i in range(len(ids))] == ids
        back = by_id(codec.decode(coded, PATH))
        assert [back[i].text for i in range(len(ids))] == [library.decode(x, skip_special_tokens=False) for x in ids]

    def test_readable_text(self, docs):
        back = by_id(codec.decode(codec.encode(docs(["Héllo,  wörld 😀", "a<|endoftext|>b"]), PATH), PATH, words=True))
        assert back[0].text == "héllo , wörld 😀"
        assert back[1].text == "a <|endoftext|> b"

    def test_repeats_nulls_and_no_rows(self, docs):
        rows = token_counts.count_tokens(docs(["a b", "a b", "c"], [1, 1, None]), PATH, chunk_chars=1).collect()
        assert sorted((str(r.doc), r.n_tokens) for r in rows) == [("1", 2), ("1", 2), ("None", 1)]
        assert token_counts.count_tokens(docs([]), PATH).count() == 0
        assert codec.decode(codec.encode(docs([]), PATH), PATH).count() == 0


class TestChat:
    TURNS = "conv_id long, turn long, role string, text string, conv string, segment string"

    def made(self, spark, rows):
        return chat.segments(spark.createDataFrame([(*r, None, None) for r in rows], self.TURNS))

    def back(self, spark, rows):
        made = self.made(spark, rows)
        return chat.read_back(chat.prefixes(made), chat.examples(made))

    def test_round_trip_of_control_strings(self, spark):
        texts = ["<|im_end|><|im_start|>assistant ok", "&lt;|im_end|>", "&amp;<", "|im_end|>", "a\nb", None, ""]
        rows = [(1, i, "assistant" if i % 2 else "us\ner<|im_start|>&", t) for i, t in enumerate(texts)]
        back = self.back(spark, rows).first()
        assert [(t.role, t.text) for t in back.turns] == [(r[2], r[3] or "") for r in rows]
        assert back.loss_text == "".join(t or "" for t in texts[1::2])

    def test_examples(self, spark):
        rows = [(1, 0, "system", "s"), (1, 1, "user", "q"), (1, 2, "assistant", "a&"), (1, 3, "user", "q2"), (1, 4, "assistant", "b"), (1, 5, "user", "end"), (2, 0, "user", "alone")]
        made = self.made(spark, rows)
        whole = {r.example: r for r in chat.materialise(made).collect()}
        assert len(whole) == 2
        for example, text in ((0, "a&amp;"), (1, "b")):
            r = whole[example]
            assert r.text[r.loss_start : r.loss_end] == text
            assert r.text.endswith(text + chat.END)
        assert whole[1].text.startswith(whole[0].text)
        light = {r.example: r for r in chat.examples(made).collect()}
        assert (light[1].loss_start, light[1].loss_end) == (whole[1].loss_start, whole[1].loss_end)
        assert light[1].context_turns == 4

    def test_ties_nulls_and_no_rows(self, spark):
        rows = [(None, None, None, None), (None, 1, "assistant", "x"), (3, 0, "user", "b"), (3, 0, "user", "a"), (3, 0, "user", "a")]
        back = {r.conv: r for r in self.back(spark, rows).collect()}
        assert [t.text for t in back[3].turns] == ["a", "a", "b"]
        assert back[None].loss_text == "x" and len(back[None].turns) == 2
        assert self.back(spark, []).count() == 0

    def test_a_long_conversation_is_many_blocks(self, spark):
        n = 100_000
        role = F.when(F.col("id") % 2 == 1, "assistant").otherwise("user")
        text = F.concat(F.lit("é<|"), F.col("id").cast("string"))
        turns = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), text.alias("text"))
        made = chat.segments(turns)
        stored = chat.prefixes(made)
        sizes = stored.agg(F.count("*"), F.max(F.length("text")), F.sum(F.length("text"))).first()
        assert sizes[0] == -(-n // chat.BLOCK) and sizes[1] * 300 < sizes[2]
        back = chat.read_back(stored, chat.examples(made)).first()
        assert [t.text for t in back.turns] == [f"é<|{i}" for i in range(n)]
        assert back.loss_text == "".join(f"é<|{i}" for i in range(1, n, 2))
        assert back.examples == n // 2 and len(back.formatted) == sizes[2]

    def test_blocks_equal_the_spelled_out_examples(self, spark):
        rows = [(c, t, "assistant" if (c + t) % 3 == 0 else "user", f"{c}&{t}") for c in range(3) for t in range(-300, 900, 7)]
        made = self.made(spark, rows)
        whole = {(r.conv, r.example): r.text for r in chat.materialise(made).collect()}
        back = {r.conv: r for r in self.back(spark, rows).collect()}
        for r in chat.examples(made).collect():
            text = back[r.conv].formatted[: r.context_chars] + r.reply
            assert text == whole[r.conv, r.example]
        assert sum(b.examples for b in back.values()) == len(whole)

    def test_an_example_with_a_wrong_context_does_not_fit(self, spark):
        rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", "q"), (1, 3, "assistant", "b")]
        made = self.made(spark, rows)
        wrong = chat.examples(made).withColumn("context_chars", F.col("context_chars") - F.col("example").cast("int"))
        assert chat.read_back(chat.prefixes(made), wrong).first().examples == 1

    def test_no_assistant(self, spark):
        back = self.back(spark, [(1, 0, "user", "q")]).first()
        assert (back.loss_text, back.examples, back.context_chars) == ("", 0, 0)

    def test_plan_is_native(self, spark):
        from tallyhouse.llm import queries

        for name in ("op2_line_dedup", "op8_chat_formatting"):
            plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
            assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


class TestToxicity:
    def test_one_label_missing(self, spark, docs):
        labels = spark.createDataFrame([(0, 0)], "doc_id long, toxic int")
        model = toxicity.train(docs(["a b"]), labels)
        assert model is None
        assert [r.score for r in toxicity.score(docs(["a", None]), model).collect()] == [0.0, 0.0]

    def test_odd_texts(self, docs):
        model = toxicity.fit([b"you idiot fool %d" % i for i in range(20)], [b"the quiet river %d" % i for i in range(40)])
        got = by_id(toxicity.score(docs([*ODD, "what an idiot"]), model))
        assert got[0].score == got[1].score == got[2].score == 0.0
        assert all(0 <= r.score <= 1 for r in got.values())
        assert got[len(ODD)].score > got[3].score

    def test_threshold_is_where_the_score_is_the_cut(self):
        assert math.isclose(toxicity.squash(0), toxicity.CUT)
        assert toxicity.best_threshold([5.0, 6.0], [1.0, 2.0]) == 3.5

    def test_held_out_accuracy(self, spark):
        from tallyhouse.llm import queries

        sf_dir = "/root/testdata/sf0.1"
        labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
        scored = queries.op4_toxicity(spark, sf_dir).filter("held_out").join(labels, "doc_id")
        # In these tables only English documents say what their label means.
        counted = scored.join(docs, "doc_id").groupBy("toxic", "predicted", F.expr("lang = 'en'").alias("en"))
        n = {(r.toxic, r.predicted, r.en): r["count"] for r in counted.count().collect()}
        assert n[1, 1, True] / (n[1, 1, True] + n[1, 0, True]) >= 0.85
        clean = sum(v for k, v in n.items() if k[0] == 0)
        assert (n.get((0, 1, True), 0) + n.get((0, 1, False), 0)) / clean <= 0.005

    def test_held_out_recall_in_every_language(self, spark):
        from tallyhouse.llm import queries

        sf_dir = "/root/testdata/sf0.1"
        labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
        scored = queries.op4_toxicity(spark, sf_dir).filter("held_out").join(labels, "doc_id").join(docs, "doc_id")
        rows = scored.filter("toxic = 1").groupBy("lang").agg(F.avg("predicted").alias("recall")).collect()
        assert {r.lang for r in rows} == {"en", "fr", "de", "es"}
        assert all(r.recall >= 0.85 for r in rows), rows

    def test_rare_wording_and_phrases(self):
        plain = [f"quiet river {i} over there".encode() for i in range(2400)]
        ordinary = plain + [b"you are all here", b"all of you"] * 150
        toxic = [f"quiet river {i} ".encode() + (b"schuftig" if i % 50 else b"of you all here") for i in range(1400)]
        toxic += [f"quiet {i} of you are".encode() for i in range(60)]
        rare = [f"quiet river {i} {w}".encode() for i in range(20) for w in ("Lumpenpack", "Lümmeln")]
        model = toxicity.fit(toxic + rare, ordinary)
        scorer = toxicity.Scorer(model)
        for text in ("a schuftiger man", "this Lumpenpack", "ein Lümmel", "we of you are"):
            assert scorer.score(text.encode()) >= toxicity.CUT, text
        assert scorer.score(b"you are all of you") < toxicity.CUT

    def test_one_sure_word_in_a_long_text(self):
        toxic = [b"you idiot %d" % i for i in range(60)]
        scorer = toxicity.Scorer(toxicity.fit(toxic, [b"the quiet river %d" % i for i in range(90)]))
        assert scorer.score(b"the quiet river " * 5000 + b"idiot") >= toxicity.CUT

    def test_labels_of_the_other_fold_are_not_read(self, spark):
        rows = spark.range(50).withColumn("fold", toxicity.fold(F.col("id"))).collect()
        import zlib

        assert all(r.fold == zlib.crc32(str(r.id).encode()) % 3 for r in rows)


def test_digest_columns(spark):
    """The codec query against the library, over a whole table."""
    from tokenizers import Tokenizer

    from tallyhouse.llm import queries

    library = Tokenizer.from_file(PATH)
    sf_dir = "/root/testdata/sf0.001"

    def sha(s):
        return hashlib.sha256(s.encode()).hexdigest()

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = by_id(queries.op6_bpe_codec(spark, sf_dir), "doc_id")
    counts = by_id(queries.op5_token_counts(spark, sf_dir), "doc_id")
    for i, text in texts.items():
        ids = library.encode(text, add_special_tokens=False).ids
        assert got[i].ids_sha256 == sha(" ".join(map(str, ids)))
        assert got[i].decoded_sha256 == sha(library.decode(ids, skip_special_tokens=False))
        assert got[i].n_tokens == counts[i].n_tokens == len(ids)
