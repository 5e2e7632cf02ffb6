import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from matchspark.llm import _encode, byte_bpe, chat_format, language_id, license_scan, packing, quality, toxicity
from matchspark.llm._text import blocks, sequence_hashes, words
from tests.llm.common import empty_docs, odd_docs

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
VOCAB = P.path("byte_bpe_50k.json")
PIECES = ["a", "b", " ", "  ", "\n", "\t", " ", "　", "é", "1", "23", ".", "'s", "'ll", "\x1c", "\x85", "漢", "<|endoftext|>", "\x00", " ", "</s>", "[INST]", "\x1b", "\x1be", "\x1bb", "[/INST]", "<s>"]
MIXED = st.lists(st.sampled_from(PIECES), max_size=40).map("".join)


@settings(max_examples=200, deadline=None)
@given(st.lists(MIXED, min_size=1, max_size=6))
def test_words_are_bytes_split(texts):
    for at, buf, offsets in blocks(pa.array(texts)):
        s, e, h, first = words(buf, offsets)
        raw = buf.tobytes()
        for i in range(len(offsets) - 1):
            assert [raw[a:b] for a, b in zip(s[first[i] : first[i + 1]], e[first[i] : first[i + 1]])] == texts[at + i].encode().split()


def own_tokenizer():
    """The contract's own call, made here."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(VOCAB)
    return lambda t: tok.encode(t or "", add_special_tokens=False).ids


def own_encoding():
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


@pytest.mark.parametrize("stretch,block", [(3, 10), (1 << 18, 1 << 23)])
def test_pieces_give_the_ids_of_whole_texts(monkeypatch, stretch, block):
    monkeypatch.setattr(_encode, "STRETCH", stretch)
    monkeypatch.setattr(_encode, "BLOCK", block)
    bpe, tok = own_encoding(), own_tokenizer()

    @settings(max_examples=150, deadline=None)
    @given(st.lists(MIXED, min_size=1, max_size=6))
    def check(texts):
        for encoder, whole in ((byte_bpe._encoder(RANKS, P.PATTERN), bpe), (packing._encoder(VOCAB), tok)):
            assert ids_of_rows(encoder, texts) == [whole(t) for t in texts]

    check()


def ids_of_rows(encoder, texts):
    out = []
    for at, ids, b in encoder.rows(pa.array(texts, pa.string())):
        assert at == len(out)
        out += [ids[x:y].tolist() for x, y in zip(b, b[1:])]
    return out


def thue_morse(n):
    a, b = "a", "b"
    while len(a) < n:
        a, b = a + b, b + a
    return a, b


def test_texts_that_modular_hashes_confuse(spark):
    """Thue and Morse's strings: power-of-two rolling hashes of both are equal."""
    pair = thue_morse(2048)
    docs = spark.createDataFrame(list(enumerate(pair)), "doc_id long, text string")
    bpe = own_encoding()
    digest = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert {r.doc_id: r.ids_sha256 for r in byte_bpe.round_trip(docs, RANKS, P.PATTERN).collect()} == {i: digest(bpe(t)) for i, t in enumerate(pair)}
    check_packing(packing.pack(docs, VOCAB).collect(), list(enumerate(pair)))
    for at, buf, offsets in blocks(pa.array([*pair, " ".join(pair[0]), " ".join(pair[1])])):
        s, e, h, first = words(buf, offsets)
        assert h[0] != h[1]
        assert len(set(sequence_hashes(h, first[2:-1], first[3:]).tolist())) == 2


def test_remembered_pieces_age(monkeypatch):
    bpe = own_encoding()
    small = _encode.PieceEncoder(bpe, most=40)
    rnd = random.Random(1)
    for _ in range(300):
        text = " ".join(rnd.choice(["alpha", "beta\nx", "gamma", "  ", "delta" * 20]) for _ in range(12))
        assert ids_of_rows(small, [text, "alpha"]) == [bpe(text), bpe("alpha")]


def test_packing_joins_pieces_and_remembers_few(monkeypatch):
    tok, encoder = own_tokenizer(), packing._encoder.__wrapped__(VOCAB)
    calls = []
    once = encoder.encode_joined
    encoder.encode_joined = lambda text: calls.append(text) or once(text)
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdeé'1&") for _ in range(rnd.randint(1, 9)))
    texts = ["".join(word() + rnd.choice([" ", " ", "\n", "  ", " \n", "\u00a0 "]) for _ in range(400)) + "z" for _ in range(20)] + ["", " ", "\n", "a ", "a \n", None]
    for size in (1 << 24, 3000):
        monkeypatch.setattr(_encode, "JOINED_BLOCK", size)
        monkeypatch.setattr(_encode, "JOINED", 1000 if size > 3000 else 7)
        assert ids_of_rows(encoder, texts) == [tok(t or "") for t in texts]
        if size > 3000:
            assert len(calls) < 20 and len(encoder.known) < 100


def test_packing_encodes_a_plain_word_once(monkeypatch):
    """Whatever marks follow it, and in later blocks too; beyond MOST_WORDS, words are encoded again."""
    tok, encoder = own_tokenizer(), packing._encoder.__wrapped__(VOCAB)
    seen = Counter()
    once = encoder.encode_words
    encoder.encode_words = lambda text: seen.update(text.split()) or once(text)
    rnd = random.Random(3)
    words = sorted({"".join(rnd.choice("abcdeéßɏÀ") for _ in range(rnd.randint(1, 9))) for _ in range(300)})
    texts = [" ".join(rnd.choice(words) + rnd.choice(["", "", ".", ",", "!?", "...", "'s", "1", ".\nAb", "×", "Ġ", "ɐ"]) for _ in range(200)) for _ in range(30)] + ["", " ", " .", " a.", None]
    monkeypatch.setattr(_encode, "JOINED_BLOCK", 3000)
    monkeypatch.setattr(_encode, "JOINED", 50)
    want = [tok(t or "") for t in texts]
    assert ids_of_rows(encoder, texts) == want
    assert len(seen) > 250 and max(seen.values()) == 1
    monkeypatch.setattr(_encode, "MOST_WORDS", 100)
    assert ids_of_rows(encoder, texts + texts) == want + want
    assert len(encoder.words) <= len(words) + 1 and max(seen.values()) > 1


def test_bpe_of_odd_rows(spark):
    docs = odd_docs(spark)
    out = byte_bpe.round_trip(docs, RANKS, P.PATTERN).collect()
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert sorted((r.doc_id or -1, r.decoded_sha256) for r in out) == sorted((r.doc_id or -1, digest(r.text)) for r in docs.collect())
    assert byte_bpe.round_trip(empty_docs(spark), RANKS, P.PATTERN).count() == 0
    huge = spark.createDataFrame([(1, " " * 300_000 + "x"), (2, "a" * 100_000), (3, "é 　" * 20_000)], "doc_id long, text string")
    encoded = byte_bpe.encode(huge, RANKS, P.PATTERN)
    raw = {r.doc_id: bytes(r.raw).decode() for r in byte_bpe.decode(encoded, RANKS).collect()}
    assert raw == {r.doc_id: r.text for r in huge.collect()}
    bpe = own_encoding()
    assert {r.doc_id: r.ids for r in encoded.where("doc_id > 1").collect()} == {2: bpe("a" * 100_000), 3: bpe("é 　" * 20_000)}
    blank = spark.createDataFrame([(1, " " * 30_000 + "x")], "doc_id long, text string")  # as long as tiktoken's own pattern goes
    assert byte_bpe.encode(blank, RANKS, P.PATTERN).first().ids == bpe(" " * 30_000 + "x")


def test_bpe_query(spark, sf_dir):
    bpe = own_encoding()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in byte_bpe.op6_byte_bpe(spark, sf_dir).collect():
        ids = bpe(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())


TURNS = "conv_id long, turn long, role string, text string"


def summary(convs):
    out = {}
    for conv, turns in convs.items():
        said = "".join(t for r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest(), sum(r == "assistant" for r, _ in turns))
    return out


def read(df):
    segments = chat_format.placed(chat_format.format_turns(df))
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.n_examples) for r in chat_format.read_back(segments, chat_format.examples(segments)).collect()}


def rendered(role, text):
    """A segment by the template, written out by hand."""
    def broken(x):
        x = (x or "").replace("\x1b", "\x1be")
        for c in ("<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[REPLY]", "[ROLE]", "[/ROLE]"):
            x = x.replace(c, c[0] + "\x1bb" + c[1:])
        return x

    inner = {"user": f"[INST] {broken(text)} [/INST]", "system": f"[SYS] {broken(text)} [/SYS]", "assistant": f"[REPLY] {broken(text)}"}
    return "<s>" + inner.get(role, f"[ROLE] {broken(role)} [/ROLE]{broken(text)}") + "</s>"


def test_chat_round_trip(spark):
    rnd = random.Random(2)
    text = lambda: "".join(rnd.choice(PIECES + ["user", "[ROLE] x [/ROLE]", " [/INST]</s>"]) for _ in range(rnd.randint(0, 12)))
    convs = {c: [(rnd.choice(["user", "assistant", "system", "tool [INST]", ""]), text()) for _ in range(rnd.randint(1, 9))] for c in range(60)}
    df = spark.createDataFrame([(c, k, r, t) for c, turns in convs.items() for k, (r, t) in enumerate(turns)], TURNS)
    assert read(df) == summary(convs)


def test_chat_of_odd_rows(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", "x"), (1, 1, "assistant", "x"), (2, None, None, "y"), (None, 0, "user", "z"), (3, 0, "assistant", "q" * 200_000)]
    df = spark.createDataFrame(rows, TURNS).withColumns({"segment": F.lit(1), "head": F.lit(2), "body": F.lit(3)})
    assert read(df) == summary({1: [("user", ""), ("assistant", "x"), ("assistant", "x")], 2: [("", "y")], None: [("user", "z")], 3: [("assistant", "q" * 200_000)]})
    assert read(spark.createDataFrame([], TURNS)) == {}


def test_examples_hold_all_that_came_before(spark):
    df = spark.createDataFrame([(1, k, r, t) for k, (r, t) in enumerate([("user", "a"), ("assistant", "b</s>"), ("user", "c"), ("assistant", "d")])], TURNS)
    segments = chat_format.format_turns(df)
    found = chat_format.with_text(segments, chat_format.examples(chat_format.placed(segments))).orderBy("turn").collect()
    whole = "".join(r.segment for r in segments.orderBy("turn").collect())
    assert [r.n_context for r in found] == [1, 3] and found[1].text == whole and whole.startswith(found[0].text)
    assert [chat_format.unescape(r.text[r.loss_start : r.loss_start + r.loss_chars]) for r in found] == ["b</s>", "d"]
    assert whole.count("</s>") == 4  # the reply's own is broken


def test_chat_query(spark, sf_dir):
    convs = {-1: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]}
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").orderBy("conv_id", "turn").collect():
        convs.setdefault(r.conv_id, []).append((r.role, r.text))
    out = chat_format.op3_chat_format(spark, sf_dir).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.n_examples) for r in out} == summary(convs)
    assert {r.conv_id: r.formatted_chars for r in out} == {c: sum(len(rendered(*turn)) for turn in turns) for c, turns in convs.items()}


def test_examples_that_reach_elsewhere_are_an_error(spark):
    df = spark.createDataFrame([(1, k, "assistant", "abc") for k in range(3)], TURNS)
    segments = chat_format.placed(chat_format.format_turns(df))
    wrong = chat_format.examples(segments).withColumn("loss_start", F.col("loss_start") - 30)
    with pytest.raises(Exception, match="does not end with"):
        chat_format.read_back(segments, wrong).collect()


def test_language_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    r = language_id.op2_language_id(spark, sf_dir).join(docs, "doc_id").groupBy("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("right"), F.count(F.lit(1)).alias("n")).collect()
    assert len(r) == 2 and all(x.right > 0.97 for x in r)


def test_language_of_odd_rows(spark):
    model = language_id.train(spark.createDataFrame([(1, "the cat and the hat", "en"), (2, "der Hund und die Katze", "de"), (3, None, "fr"), (4, "x", None)], "doc_id long, text string, lang string"))
    out = language_id.predict(odd_docs(spark), model).collect()
    assert len(out) == 11 and {r.lang_pred for r in out} <= {"en", "de", "und"} and all(0 <= r.score <= 1 for r in out)
    assert {r.doc_id for r in out if r.lang_pred == "und"} == {2, 3, 4, 8}
    none = language_id.train(empty_docs(spark))
    assert {(r.lang_pred, r.score) for r in language_id.predict(odd_docs(spark), none).collect()} == {("und", 0.0)}
    assert language_id.predict(empty_docs(spark), model).count() == 0


def brute_grams(texts, buckets):
    """Counts of the hashed n-grams one by one."""
    out = Counter()
    mask = (1 << 64) - 1
    for t in texts:
        t = " " + t.lower().replace("\0", " ") + " "
        for i in range(len(t)):
            h = 0
            for n in range(1, max(language_id.ORDERS) + 1):
                if i + n > len(t):
                    break
                h = (h + ord(t[i + n - 1]) + n) * 0x9E3779B97F4A7C15 & mask
                h ^= h >> 29
                if n in language_id.ORDERS:
                    out[n, (h * 0xBF58476D1CE4E5B9 & mask) >> (64 - buckets.bit_length() + 1)] += 1
    return out


def test_grams():
    texts = ["Ab c", "", "É\0x", "a"]
    got = Counter()
    for n, (found, bounds) in zip(language_id.ORDERS, language_id.gram_buckets(texts, 1 << 10)):
        assert len(bounds) == len(texts) + 1 and bounds[-1] == len(found)
        got.update((n, int(b)) for b in found)
    assert got == brute_grams(texts, 1 << 10)


def test_language_by_hand(spark):
    """lang_pred and score against n-grams counted one by one; rare tags beyond the bound are not learned."""
    import math

    texts = {"en": ["the cat sat on the mat", "that hat"], "de": ["der hund und die katze", "das haus"], "fr": ["le chat est là"]}
    rows = [(k, t, lang) for k, (lang, t) in enumerate((lang, t) for lang, own in texts.items() for t in own)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 1 << 10)
    counts = {lang: brute_grams(own, 1 << 10) for lang, own in texts.items()}
    flat = {lang: Counter() for lang in texts}
    for lang, own in counts.items():
        for (_, bucket), n in own.items():
            flat[lang][bucket] += n
    asked = ["the dog", "la katze", "und", "x", "est le mat", "the dog"]
    want = []
    for t in asked:
        logs = {}
        for lang, own in flat.items():
            total = sum(own.values()) + 0.5 * (1 << 10)
            logs[lang] = math.log(len(texts[lang]) / len(rows)) + sum(n * math.log((own[b] + 0.5) / total) for (_, b), n in brute_grams([t], 1 << 10).items())
        top = max(sorted(logs), key=logs.get)
        want.append((top, 1 / sum(math.exp(x - logs[top]) for x in logs.values())))
    out = sorted(language_id.predict(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), model).collect())
    assert [r.lang_pred for r in out] == [x for x, _ in want] and [r.score for r in out] == pytest.approx([x for _, x in want], rel=1e-4)


def test_language_of_one_long_text_in_slices(spark, monkeypatch):
    model = language_id.train(spark.createDataFrame([(1, "the cat and the hat", "en"), (2, "der Hund und die Katze", "de")], "doc_id long, text string, lang string"), 1 << 8)
    columns = [model["matrix"][:, k] for k in range(2)]
    text = "The cat und der hat, die É\0 katze and " * 9
    whole = language_id._sums([language_id.folded(text)], columns, 1 << 8)
    for size in (2, 5, 64, 1000):
        monkeypatch.setattr(language_id, "BLOCK_CHARS", size)
        assert np.allclose(language_id._long_sums(text, columns, 1 << 8), whole)


W = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    w = W.findall(text)
    windows = Counter(zip(w, w[1:], w[2:]))
    covered = {j for i, x in enumerate(zip(w, w[1:], w[2:])) if windows[x] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if W.search(x)]
    repeats = len(covered)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), repeats, len(w) < 50 or 100 * repeats > 50 * len(w)


def test_quality_counts(spark, sf_dir):
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.op4_quality(spark, sf_dir).collect()}
    assert got == {r.doc_id: base(r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def test_quality_of_odd_rows(spark):
    rnd = random.Random(9)
    rows = [(i, "".join(rnd.choice(["a", "b", " ", "\n", "#", "é", "\x0b", "a a a ", "\n\n"]) for _ in range(rnd.randint(0, 300)))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.with_counts(docs).collect()} == {i: base(t) for i, t in rows}
    none = spark.createDataFrame([], "doc_id long")
    ratio = quality.train(odd_docs(spark), none, 64)
    assert ratio == [0.0] * 64
    out = quality.verdicts(quality.with_counts(odd_docs(spark)), ratio).collect()
    assert len(out) == 11 and all(r.kept == (not r.base_failed) for r in out)
    assert quality.verdicts(quality.with_counts(empty_docs(spark)), ratio).count() == 0


def test_quality_of_texts_with_more_words_than_places(spark, monkeypatch):
    monkeypatch.setattr(quality, "_PLACE", 3)
    rnd = random.Random(3)
    rows = [(i, " ".join(rnd.choice("abc") for _ in range(rnd.randint(0, 40)))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.n_repeat_words for r in quality.with_counts(docs).collect()} == {i: base(t)[4] for i, t in rows}


def test_quality_verdicts_by_hand(spark):
    """kept and llr against bucket counts summed one by one."""
    import math

    rnd = random.Random(12)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(rnd.choice(words[: 10 if i % 2 else 40]) for _ in range(rnd.randint(40, 90)))) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    good = {i for i, _ in rows if i % 2}
    ratio = quality.train(docs, docs.where("doc_id % 2 = 1").select("doc_id"), 64)
    grams = {i: [(w[k],) for k in range(len(w))] + [(w[k], w[k + 1] if k + 1 < len(w) else "") for k in range(len(w))] for i, w in ((i, t.split()) for i, t in rows)}
    distinct = sorted({g for x in grams.values() for g in x})
    table = spark.createDataFrame([(k, g[0], g[1] if len(g) > 1 else None) for k, g in enumerate(distinct)], "k int, a string, b string")
    hashed = table.select("k", F.when(F.col("b").isNull(), F.pmod(F.xxhash64("a"), F.lit(64))).otherwise(F.pmod(F.xxhash64("a", "b"), F.lit(64))).alias("bucket"))
    bucket = {distinct[r.k]: int(r.bucket) for r in hashed.collect()}
    raw, trusted = [0] * 64, [0] * 64
    for i, own in grams.items():
        for g in own:
            raw[bucket[g]] += 1
            trusted[bucket[g]] += i in good
    weight = [round(math.log((t + 1) / (sum(trusted) * r / sum(raw) + 1)), 5) for t, r in zip(trusted, raw)]
    assert [round(x, 5) for x in ratio] == weight
    out = {r.doc_id: r for r in quality.verdicts(quality.with_counts(docs), ratio).collect()}
    for i, text in rows:
        llr = sum(weight[bucket[g]] for g in grams[i]) / len(grams[i])
        assert out[i].llr == pytest.approx(llr, abs=1e-9)
        assert out[i].kept == (not base(text)[5] and llr >= quality.THRESHOLD - quality.SLACK / math.sqrt(len(grams[i])))


def test_many_languages_go_in_passes(spark, monkeypatch):
    rows = [(i, text, lang) for i, (text, lang) in enumerate([("the cat and the hat", "en"), ("der Hund und die Katze", "de"), ("le chat et le chien", "fr"), ("el gato y el perro", "es"), ("il gatto e il cane", "it")] * 3)]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    asked = spark.createDataFrame([(1, "the dog"), (2, "die Katze"), (3, "le chien"), (4, "y el"), (5, "cane"), (6, None), (7, "..."), (8, "x " * 50)], "doc_id long, text string")
    whole = language_id.train(train, 1 << 10)
    one = sorted(map(tuple, language_id.predict(asked, whole).collect()))
    monkeypatch.setattr(language_id, "LANGS_A_PASS", 2)
    model = language_id.train(train, 1 << 10)
    assert (model["matrix"] == whole["matrix"]).all() and model["langs"] == whole["langs"]
    several = sorted(map(tuple, language_id.predict(asked, model).collect()))
    assert [r[:2] for r in several] == [r[:2] for r in one] and several[:5] != several[5:]
    assert all(a[2] == pytest.approx(b[2], rel=1e-9) for a, b in zip(several, one))


def test_quality_separates_at_two_sizes(spark):
    """Good and bad texts apart by llr, at either size; there are as many buckets at either."""
    for sf in ("sf0.001", "sf0.01"):
        labels = spark.read.parquet(f"/root/testdata/{sf}/labels.parquet")
        mean = {r.quality: r.m for r in quality.op4_quality(spark, f"/root/testdata/{sf}").join(labels, "doc_id").groupBy("quality").agg(F.avg("llr").alias("m")).collect()}
        assert mean[1] > mean[0]


def test_quality_is_native_and_tells_junk(spark, sf_dir):
    df = quality.op4_quality(spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    share = {r.quality: r.k for r in df.join(labels, "doc_id").where("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()}
    assert share[1] > 0.95 and share.get(0, 0) < 0.6


def test_llr_by_hand(spark):
    docs = spark.createDataFrame([(1, "good words here " * 30), (2, "bad|bad " * 60)], "doc_id long, text string")
    ratio = quality.train(docs, docs.where("doc_id = 1").select("doc_id"), 256)
    out = {r.doc_id: r.llr for r in quality.verdicts(quality.with_counts(docs), ratio).collect()}
    assert out[1] > 0 > out[2]


def best_segments(scores):
    """The recursive definition: the best contiguous stretch (shortest, leftmost), then both sides."""
    def split(lo, hi):
        best = max(((sum(scores[a:b]), a - b, -a, a, b) for a in range(lo, hi) for b in range(a + 1, hi + 1)), default=(0,))
        return split(lo, best[3]) + [best[3:]] + split(best[4], hi) if best[0] > 0 else []

    return split(0, len(scores))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-5, 5), max_size=25))
def test_all_maximal_segments(scores):
    found = toxicity.segments([float(x) for x in scores])
    assert sum(s for *_, s in found) == sum(sum(scores[a:b]) for a, b in best_segments(scores))
    assert all(s == sum(scores[a:b]) > 0 for a, b, s in found) and all(x[1] <= y[0] for x, y in zip(found, found[1:]))


def test_toxicity_query(spark):
    sf_dir = "/root/testdata/sf0.01"  # the smallest tables have too few toxic labels to learn from
    out = toxicity.op8_toxicity(spark, sf_dir)
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    rows = out.join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").collect()
    assert out.count() == n and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    clean = [r.predicted for r in rows if r.toxic == 0]
    toxic = [r.predicted for r in rows if r.toxic == 1]
    assert sum(clean) <= 0.03 * len(clean) and sum(toxic) >= 0.5 * len(toxic)


def toxic_corpus(spark):
    rnd = random.Random(4)
    plain = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(240):
        text = [rnd.choice(plain) for _ in range(80)]
        if i % 3 == 0:
            for p in rnd.sample(range(20, 60), 4):
                text[p] = rnd.choice(["Nastyword,", "vileword", "(foulword)"])
        rows.append((i, " ".join(text), int(i % 3 == 0)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_toxicity_learns_and_finds_passages(spark):
    corpus = toxic_corpus(spark)
    train, held = corpus.where("doc_id < 180"), corpus.where("doc_id >= 180")
    model = toxicity.train(train.select("doc_id", "text"), train.select("doc_id", "toxic"))
    assert len(model.tokens) == 3 and (model.scores > 0).all()
    got = {r.doc_id: r.score >= 0.5 for r in toxicity.score(held, model).collect()}
    assert got == {r.doc_id: bool(r.toxic) for r in held.collect()}
    found = toxicity.find_passages(held, model).collect()
    assert {r.doc_id for r in found} == {i for i, hit in got.items() if hit} and all(20 <= r.first_word < r.end_word <= 60 for r in found)
    out = toxicity.score(odd_docs(spark), model).collect()
    assert len(out) == 11 and all(r.score < 0.5 for r in out)
    assert toxicity.score(empty_docs(spark), model).count() == 0
    empty = toxicity.train(empty_docs(spark), spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.score for r in toxicity.score(odd_docs(spark), empty).collect()} == {0.0}


def test_toxicity_scores_by_hand(spark):
    """Scores against token scores looked up one by one and segments by their definition; ties and repeats score alike."""
    import math

    corpus = toxic_corpus(spark)
    model = toxicity.train(corpus.select("doc_id", "text"), corpus.select("doc_id", "toxic"))
    value = dict(zip(model.tokens.tolist(), model.scores.tolist()))

    def token(word):
        found, _ = toxicity.token_hashes(np.frombuffer(word.encode(), np.uint8), np.array([0, len(word.encode())]))
        return int(found[0])

    texts = {r.doc_id: r.text for r in corpus.where("doc_id % 4 = 0").collect()} | {1000: "vileword", 1001: "vileword", 1002: "a b"}
    want = {}
    for i, text in texts.items():
        scores = [value.get(token(w), -model.drift) for w in text.split()]
        high = [x for a, b in best_segments(scores) if (x := model.rate * sum(scores[a:b]) - math.log(len(scores))) > toxicity.SIGNIFICANT]
        want[i] = 1 / (1 + math.exp(-(model.slope * math.log1p(sum(high)) + model.offset)))
    got = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), model).collect()}
    assert got == pytest.approx(want, rel=1e-9) and got[1000] == got[1001] and len(set(want.values())) > 3


@pytest.mark.parametrize("text,ids,licenses,left,verdict", [
    ("Released under the MIT License.", "MITref", "MIT", 0, "one"),
    ("x\nLicensed under the Apache Licence, Version 2.0\nReleased under the MIT License", "Apache2ref,MITref", "Apache-2.0,MIT", 0, "several"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License\neither version 3 of the License, or (at your option) any later version.", "GPLgrant,GPL3later", "GPL-3.0-or-later", 0, "one"),
    ("All rights reserved.", "AllRights", "", 1, "none"), ("a license of sorts", None, None, None, None), ("", None, None, None, None), (None, None, None, None, None),
])
def test_license_rules(spark, text, ids, licenses, left, verdict):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string").withColumn("ids", F.lit(1))
    assert [tuple(r) for r in license_scan.scan(docs).collect()] == ([] if ids is None else [(1, ids, licenses, left, verdict)])


MIT_NOTICE = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD_NOTICE = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
GPL_NOTICE = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program.  If not, see <https://www.gnu.org/licenses/>."""
MPL_NOTICE = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."


ISC_NOTICE = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
ZLIB_NOTICE = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
LGPL_NOTICE = """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.

You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation."""
NOTICES = {
    "MIT": MIT_NOTICE, "BSD-3-Clause": BSD_NOTICE, "Apache-2.0": APACHE_NOTICE, "GPL-3.0-or-later": GPL_NOTICE, "MPL-2.0": MPL_NOTICE, "ISC": ISC_NOTICE, "Zlib": ZLIB_NOTICE,
    "LGPL-2.1-or-later": LGPL_NOTICE.replace("this library; if not, write to the Free Software Foundation.", "this library. If not, write."),
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "AGPL-3.0-or-later": "SPDX-License-Identifier: AGPL-3.0-or-later", "EPL-2.0": "This project is licensed under the Eclipse Public License 2.0.",
}


def test_every_known_sentence_passes_the_hint():
    raw = [*license_scan.SENTENCES, *license_scan.FULL_SENTENCES, *license_scan._references()]
    assert len(set(raw)) > 250 and [x for x in raw if not re.search(license_scan.HINT, x)] == []
    several, single = license_scan._rules()
    ids = set(license_scan._known().values())
    assert {i for rule, _ in several for i in rule.split(",")} | set(single) <= ids


def test_licenses_of_verbatim_notices(spark):
    import textwrap

    rows, want = [], {}
    for name, text in NOTICES.items():
        for mark in (None, "", " * "):
            shown = text if mark is None else "\n".join(mark + x for p in text.split("\n") for x in (textwrap.wrap(p, 70) or [""]))
            want[len(rows)] = (name, 0, "one")
            rows.append((len(rows), "Some words before.\n\n" + shown + "\n\nSome words after."))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.licenses, r.n_unexplained, r.verdict) for r in license_scan.scan(docs).collect()} == want


def test_license_of_odd_rows(spark):
    assert license_scan.scan(odd_docs(spark)).count() == 0 and license_scan.scan(empty_docs(spark)).count() == 0


def check_packing(rows, texts):
    """rows against whole encodings: every id in one piece, sequences gapless and full but the last."""
    import zlib

    tok = own_tokenizer()
    by = {}
    for r in rows:
        by.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    want = Counter()
    for i, t in texts:
        want[i, len(tok(t)) + 1] += 1
    assert {k: len({(r.sequence_id, r.offset) for r in v if r.start == 0}) for k, v in by.items()} == dict(want)
    ids_of = {i: np.array(tok(t) + [0], "<u4") for i, t in texts}
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(ids_of[r.doc_id][r.start : r.start + r.length])
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    ends = []
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        ends.append(at)
    assert all(x <= 1024 for x in ends) and sum(x < 1024 for x in ends) <= 1
    assert sum(ends) == sum(len(ids_of[i]) for i, _ in texts)


def test_packing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check_packing(packing.op10_packing(spark, sf_dir).collect(), [(r.doc_id, r.text) for r in docs.collect()])
    odd = odd_docs(spark)
    check_packing(packing.pack(odd, VOCAB).collect(), [(r.doc_id, r.text) for r in odd.collect()])
    marked = spark.createDataFrame([(1, "a <|endoftext|> b"), (2, "<|endoftext|>" * 900), (3, "plain")], "doc_id long, text string").withColumns({"row": F.lit(1), "n": F.lit(2), "ids": F.lit("x"), "key": F.lit(0), "first": F.lit(9), "c0": F.lit("y")})
    check_packing(packing.pack(marked, VOCAB).collect(), [(r.doc_id, r.text) for r in marked.collect()])
    assert packing.pack(empty_docs(spark), VOCAB).count() == 0


def test_hilbert_neighbours_touch():
    side = np.array([[x, y, z] for x in range(8) for y in range(8) for z in range(8)])
    key = packing.hilbert_key(side, 3)
    assert sorted(key) == list(range(512))
    walk = side[np.argsort(key)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()



def test_tasks_of_the_pipeline_give_memory_back(monkeypatch):
    """After its last batch a task returns what it freed; its rows are untouched."""
    from matchspark.llm import _text

    calls = []
    monkeypatch.setattr(_text.pa, "default_memory_pool", lambda: type("Pool", (), {"release_unused": lambda self: calls.append(1)})())
    assert list(_text.trimmed(lambda batches: (b + 1 for b in batches))(iter([1, 2, 3]))) == [2, 3, 4] and calls == [1]
