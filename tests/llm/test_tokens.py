import base64
import random

import pytest
import tiktoken

from gistmill.llm.bpe_automaton import BpeAutomaton
from gistmill.llm.encode_corpus import encode_corpus
from gistmill.llm.mixing import mix
from gistmill.llm.splitting import split_texts
from gistmill.llm.tokens import BYTE_LEVEL, FOLDER

ODD = ["don't we'll I'm \u0645\u0631 \u0e01\u0e34", "'S 'tis ''s", "", None, " ", "\n\n", "Hello  world\r\n\tx", "<|endoftext|> it's", "naïve Ünïcode – № ١٢ 日本語 😀👍🏽", "\x85\xa0　x", "\U00010450͸a", "a" * 3000, "12345 " * 50, " \n \n ", "Was it? Yes. " * 80]


@pytest.fixture(scope="module")
def library():
    with open(f"{FOLDER}/byte_bpe_50k.tiktoken", "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})


def documents(spark, texts):
    rows = [(i, t, "a" if i % 2 else "b") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_automaton_against_plain_merging():
    """A small vocabulary with overlapping merges; plain merging applies the least rank, leftmost first, until none applies."""
    merges = [(b"a", b"b"), (b"b", b"a"), (b"ab", b"a"), (b"a", b"a"), (b"aa", b"b"), (b"ba", b"b"), (b"aba", b"b"), (b"c", b"ab"), (b"cab", b"a")]
    vocabulary = {bytes([c]): k for k, c in enumerate(b"abc")} | {x + y: 3 + k for k, (x, y) in enumerate(merges)}
    machine = BpeAutomaton(vocabulary, merges)
    rank = {m: k for k, m in enumerate(merges)}
    random.seed(1)
    for _ in range(3000):
        word = bytes(random.choice(b"abc") for _ in range(random.randint(0, 14)))
        parts = [bytes([c]) for c in word]
        while True:
            options = [(rank[p], k) for k, p in enumerate(zip(parts, parts[1:])) if p in rank]
            if not options:
                break
            r, _ = min(options)
            k = next(k for x, k in options if x == r)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        assert machine.encode(word) == [vocabulary[p] for p in parts], word


def test_ids_equal_the_librarys(spark, library):
    rows = encode_corpus(documents(spark, ODD)).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        assert r.ids == library.encode_ordinary(ODD[r.doc_id] or ""), ODD[r.doc_id]
    assert encode_corpus(documents(spark, [])).count() == 0


@pytest.mark.parametrize("tokenizer", ["byte_bpe_50k", "byte_bpe_multi_50k"])
def test_ids_come_from_the_automaton_and_decode_to_their_text(spark, tokenizer):
    """With merges in a file of their own, and with ranks only."""
    from gistmill.llm.encode_corpus import decode_corpus
    from gistmill.llm.tokens import WordCoder

    with open(f"{FOLDER}/{tokenizer}.tiktoken", "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    own = tiktoken.Encoding("own", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})
    assert WordCoder(tokenizer, FOLDER, True).automaton is not None
    coded = encode_corpus(documents(spark, ODD), tokenizer)
    assert {r.doc_id: r.ids for r in coded.collect()} == {k: own.encode_ordinary(t or "") for k, t in enumerate(ODD)}
    assert {r.doc_id: r.text for r in decode_corpus(coded, tokenizer).collect()} == {k: t or "" for k, t in enumerate(ODD)}


def test_merges_from_ranks_are_those_of_the_file():
    machine = BpeAutomaton.from_ranks(f"{FOLDER}/byte_bpe_50k.tiktoken")
    assert machine.merged == BpeAutomaton.from_json(f"{FOLDER}/byte_bpe_50k.json").merged
    with pytest.raises(ValueError):
        machine.decode([10**6])


@pytest.mark.parametrize("tokenizer,limit,overlap", [("byte_bpe_50k", 16, 4), ("byte_bpe_50k", 50, 0), ("piece_bpe_32k", 20, 3)])
def test_pieces_stay_within_their_limit(spark, library, tokenizer, limit, overlap):
    import sentencepiece

    size = library.encode_ordinary if tokenizer.startswith("byte") else sentencepiece.SentencePieceProcessor(model_file=f"{FOLDER}/{tokenizer}.model").encode
    rows = split_texts(documents(spark, ODD), [("p", tokenizer, limit, overlap)]).orderBy("doc_id", "piece_no").collect()
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    assert set(by_doc) == {i for i, t in enumerate(ODD) if t and len(size(t)) > limit}
    for i, pieces in by_doc.items():
        text = ODD[i]
        assert [p.piece_no for p in pieces] == list(range(1, len(pieces) + 1))
        assert pieces[0].start_char == 0 and pieces[-1].end_char == len(text)
        for p in pieces:
            assert p.piece == text[p.start_char : p.end_char] and p.n_tokens == len(size(p.piece)) <= limit
        for a, b in zip(pieces, pieces[1:]):
            assert a.start_char < b.start_char <= a.end_char < b.end_char


def test_cuts_at_sentences_where_there_are_any(spark):
    rows = split_texts(documents(spark, ["One two three four. Five six seven eight. Nine ten eleven twelve. " * 5]), [("p", "byte_bpe_50k", 16, 0)]).collect()
    assert all(r.piece.rstrip().endswith(".") for r in rows)


def test_mix_reaches_its_targets(spark, library):
    random.seed(2)
    rows = [(i, " ".join(random.choice("steel beam crane pump wall".split()) for _ in range(random.randint(1, 60))), s) for i, s in enumerate(["big"] * 300 + ["small"] * 20 + [None] * 5)]
    rows += [(1000, None, "big"), (1001, "", "small")]
    documents = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = [("p", "byte_bpe_50k", 0.5, "big", 0.6, 1), ("p", "byte_bpe_50k", 0.5, "small", 0.3, 2), ("p", "byte_bpe_50k", 0.5, "absent", 0.1, 3)]
    targets = spark.createDataFrame(plan, "plan string, tokenizer string, corpus_fraction double, source string, target_share double, max_repeats int")
    chosen, shares = mix(documents, targets)
    size = {i: len(library.encode_ordinary(t or "")) for i, t, _ in rows}
    total = sum(size.values())
    got = {}
    for r in chosen.collect():
        assert r.n_tokens == size[r.doc_id] > 0
        got.setdefault(r.source, []).append((r.doc_id, r.uses))
    big = sum(size[i] * u for i, u in got["big"])
    assert 0 <= int(0.3 * total) - big <= 1 + 0.001 * 0.3 * total or big <= 0.3 * total < big + min(size[i] for i, _, s in rows if s == "big" and size[i])
    assert all(u == 1 for _, u in got["big"])
    small = {i for i, _, s in rows if s == "small" and size[i]}
    # too small for its target: everything as often as it may be used
    assert dict(got["small"]) == dict.fromkeys(small, 2) and "absent" not in got
    reached = {r.source: r for r in shares.collect()}
    assert reached["absent"].tokens == 0 and reached["big"].tokens == big
    assert abs(sum(r.actual_share for r in reached.values()) - 1) < 1e-9
    assert mix(documents.where("false"), targets)[0].count() == 0


def test_mix_goes_on_behind_documents_that_do_not_fit(spark, library):
    """Few documents of very unequal size: the shares are those of the rule worked out document by document."""
    from pyspark.sql import functions as F

    random.seed(4)
    words = "steel beam crane pump wall".split()
    rows = [(i, " ".join(random.choice(words) for _ in range(random.choice([1, 3, 10, 40, 400, 1500]))), random.choice("abc")) for i in range(150)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = [("p", "byte_bpe_50k", 0.5, s, t, m) for s, t, m in (("a", 0.2, 1), ("b", 0.5, 3), ("c", 0.3, 1))]
    targets = spark.createDataFrame(plan, "plan string, tokenizer string, corpus_fraction double, source string, target_share double, max_repeats int")
    size = {i: len(library.encode_ordinary(t)) for i, t, _ in rows}
    place = {r.doc_id: (r.h, r.doc_id) for r in documents.select("doc_id", F.shiftrightunsigned(F.xxhash64("doc_id"), 1).alias("h")).collect()}
    want = {}
    for _, _, fraction, source, share, most in plan:
        of = sorted((i for i, _, s in rows if s == source), key=place.get)
        target = int(share * fraction * sum(size.values()))
        there = sum(size[i] for i in of)
        whole = min(target // there, most)
        uses, left = dict.fromkeys(of, whole), target - whole * there if whole < most else 0
        # a document counts as too large against what was left when the last one failed to fit
        for _ in range(most - whole):
            limit = left
            for i in of:
                if size[i] > limit:
                    continue
                if size[i] <= left:
                    uses[i], left = uses[i] + 1, left - size[i]
                    continue
                limit = left
                if left <= target * 0.001:
                    break
            else:
                # the last stretch ended with the order: another pass only if nothing was too large since
                if left > target * 0.001:
                    continue
            break
        want[source] = {i: u for i, u in uses.items() if u}
        assert left < target * 0.05
    got = {}
    for r in mix(documents, targets)[0].collect():
        got.setdefault(r.source, {})[r.doc_id] = r.uses
    assert got == want


def test_words_of_a_batch_are_those_of_the_pattern():
    import pyarrow as pa
    import regex

    from gistmill.llm.tokens import PIECES, cut_batch

    random.seed(3)
    parts = ["a", "s", "t", "re", "ve", "ll", "'", "'s", " ", "  ", "\n", "\t", "1", "é", "?", "\xa0", "x", "(", "😀", "日", "'d", "\x1c", "\x85", "\u200b", "٣", "\u0378"]
    texts = ["".join(random.choice(parts) for _ in range(random.randint(0, 14))) for _ in range(5000)] + [t for t in ODD if t]
    column = pa.array([None, *texts, None])[1:]
    for name, pattern in (("byte_bpe_50k", BYTE_LEVEL), ("piece_bpe_32k", PIECES)):
        borders, index, different = cut_batch(column, name)
        for k, text in enumerate(texts):
            assert [different[x] for x in index[borders[k] : borders[k + 1]].tolist()] == regex.findall(pattern, text), (name, text)
    assert cut_batch(pa.array([], pa.string()), "byte_bpe_50k")[0].tolist() == [0]
    assert cut_batch(pa.array([None, ""], pa.string()), "piece_bpe_32k")[0].tolist() == [0, 0, 0]
