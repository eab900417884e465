from __future__ import annotations

import random

import public_tokenizers
import sentencepiece

from tableweave.llm import sentencepiece_codec as C

PATH = public_tokenizers.path("piece_bpe_32k.model")


def brute(text: str, vocab: C.Vocabulary) -> float:
    best = [0.0] + [float("-inf")] * len(text)
    for s in range(len(text)):
        for e in range(s + 1, len(text) + 1):
            own = vocab.score.get(text[s:e], vocab.unknown_score if e == s + 1 else None)
            if own is not None:
                best[e] = max(best[e], best[s] + own)
    return best[-1]


def words(seed: int, n: int) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choice(["th", "er", "ing", "a", "ß", "é", "on", "str", "qu", "X", "."]) for _ in range(r.randint(1, 8))) for _ in range(n)]


def test_same_ids_as_the_library_with_these_scores():
    vocab = C.vocabulary(PATH)
    with open(PATH, "rb") as f:  # the file with its kind set to unigram, whose search is Viterbi's
        library = sentencepiece.SentencePieceProcessor(model_proto=f.read() + b"\x12\x02\x18\x01")
    for word in words(1, 500):
        assert C.Encoder(vocab).encode(word) == library.encode(word), word


def test_best_score_without_known_boundaries():
    vocab = C.vocabulary(PATH)
    for seed in range(20):
        text = C.BLANK + C.BLANK.join(words(seed, 6)) + random.Random(seed).choice(["", "\n", "中\U0001f600"])
        ids = [i for part in C.stream(text, vocab) for i in part]
        total, k = 0.0, 0
        pieces = {i: p for p, i in vocab.ids.items()}
        while k < len(ids):
            if ids[k] in pieces:
                total += vocab.score[pieces[ids[k]]]
                k += 1
            else:
                first = vocab.bytes_of[ids[k]][0]
                k += 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
                total += vocab.unknown_score
        assert abs(total - brute(text, vocab)) < 1e-3


def plain(text: str, vocab: C.Vocabulary) -> list[int]:
    """The best path over the whole text, scores of all its places kept; of equal ones that whose last piece began first."""
    best = [(0.0, [])] + [(None, [])] * len(text)
    for e in range(1, len(text) + 1):
        for s in range(max(0, e - vocab.longest), e):
            piece = text[s:e]
            if piece in vocab.score:
                step, ids = vocab.score[piece], [vocab.ids[piece]]
            elif e == s + 1:
                step, ids = vocab.unknown_score, list(vocab.of_unknown(piece))
            else:
                continue
            if best[e][0] is None or best[s][0] + step > best[e][0]:
                best[e] = (best[s][0] + step, best[s][1] + ids)
    return best[-1][1]


def test_words_and_streams_agree():
    vocab = C.vocabulary(PATH)
    assert vocab.splits
    for word in [*words(7, 300), "中中x", C.BLANK * 5, "\U0001f600"]:
        assert plain(word, vocab) == [i for part in C.stream(word, vocab) for i in part]
    for seed in range(5):
        text = " ".join(words(seed, 50)) + "\n" + " ".join(words(seed + 9, 5))
        assert C.Encoder(vocab).encode(text) == [i for part in C.stream(C.BLANK + text.replace(" ", C.BLANK), vocab) for i in part]


def test_commits_are_early():
    vocab = C.vocabulary(PATH)
    parts = list(C.stream(C.BLANK.join(words(3, 200)), vocab))
    assert len(parts) > 50 and max(map(len, parts)) < 60


def test_documents(spark):
    texts = [None, "", " ", "  two  spaces ", "line\nline\r\n\ttab", "naïve ß 中文 \U0001f600 \u0000", "a" * 20_000, " ".join(words(9, 3000)), "same", "same"]
    docs = spark.createDataFrame([(k if k else None, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, ids int")
    coded = C.encode_documents(docs, PATH)
    back = {r.doc_id: r.text for r in C.decode_documents(coded, PATH).collect()}
    assert back == {k if k else None: t or "" for k, t in enumerate(texts)}
    assert all(r.round_trip for r in C.coded_digests(docs, PATH).collect())
    assert C.coded_digests(docs.limit(0), PATH).count() == 0
