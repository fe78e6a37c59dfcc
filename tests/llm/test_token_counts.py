import math
import random

import sentencepiece
from tokenizers import Tokenizer, models

from shelfcast.llm import token_counts as tc
from shelfcast.llm.queries import op2_token_counts, tokenizer
from tests.llm.conftest import ODD

PATH = tokenizer("piece_bpe_32k.model")
FOLDER = "/root/testdata/sf0.001"


def brute(pieces, word, longest):
    """Best segmentation of one word by dynamic programming from the end, no sharing."""
    text = "▁" + word
    unknown = min(pieces.values()) - 10
    best = [(0.0, 0)] * (len(text) + 1)
    for start in range(len(text) - 1, -1, -1):
        options = []
        if text[start] not in pieces:
            s, n = best[start + 1]
            options.append((s + unknown, n + len(text[start].encode())))
        for end in range(start + 1, min(len(text), start + longest) + 1):
            if text[start:end] in pieces:
                s, n = best[end]
                options.append((s + pieces[text[start:end]], n + 1))
        best[start] = min(options, key=lambda o: (-round(o[0], 9), o[1]))
    return best[0][1]


def words_of(text):
    return [w.decode() for w in (text or "").encode().split()]


def test_query_equals_brute_force(spark):
    pieces = tc.load_pieces(PATH)
    longest = max(map(len, pieces))
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    known = {}
    for r in op2_token_counts(spark, FOLDER).collect():
        words = words_of(docs[r["doc_id"]])
        for w in words:
            if w not in known:
                known[w] = brute(pieces, w, longest)
        assert (r["n_words"], r["n_tokens"]) == (len(words), sum(known[w] for w in words))


def test_library_unigram_agrees():
    """The tokenizers library's unigram model with the same scores, on words that it needs no bytes for."""
    pieces = tc.load_pieces(PATH)
    model = Tokenizer(models.Unigram([("<unk>", min(pieces.values()) - 20), *pieces.items()], 0, False))
    trie = tc.Trie(pieces)
    words = ["the", "unbelievable", "Straße", "éreleaux", "internationalisation", "x1y2", "a"]
    assert [trie.count(w) for w in words] == [len(model.encode("▁" + w).ids) for w in words]


def test_prefixes_are_scored_once():
    trie = tc.Trie(tc.load_pieces(PATH))
    for w in ("international", "internationalise", "internal", "inter"):
        trie.count(w)
    assert trie.made == len("▁internationalise") + len("l")
    assert trie.count("internationalise") and trie.made == len("▁internationalise") + 1


def test_bounded_trie_and_long_words_change_nothing():
    pieces = tc.load_pieces(PATH)
    rnd = random.Random(2)
    words = ["".join(rnd.choices("abcdeéß漢😀", k=rnd.randint(1, 100))) for _ in range(300)]
    small, large, longest = tc.Trie(pieces, 200), tc.Trie(pieces), max(map(len, pieces))
    want = [brute(pieces, w, longest) for w in words]
    assert [small.count(w) for w in words] == [large.count(w) for w in words] == want


def test_scores_follow_rank():
    pieces = tc.load_pieces(PATH)
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    first = next(i for i in range(1000) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    assert pieces[model.id_to_piece(first)] == 0.0 and pieces[model.id_to_piece(first + 1)] == -math.log(2)


def test_odd_rows(odd_docs, no_docs):
    found = {(r["doc_id"], r["n_words"]) for r in tc.count_tokens(odd_docs, PATH).collect()}
    assert found == {(i, len(words_of(t))) for i, t in ODD}
    assert all(r["n_tokens"] == 0 for r in tc.count_tokens(odd_docs, PATH).collect() if r["n_words"] == 0)
    assert tc.count_tokens(no_docs, PATH).count() == 0
