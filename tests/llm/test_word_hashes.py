"""Words that any polynomial hash modulo a power of two takes for one another."""

import zlib
from collections import Counter
from math import log10

from pathloom.llm import common, scoring

SWAP = str.maketrans("ab", "ba")


def alternating(k: int) -> str:
    """The word of Thue and Morse, 2 ** k letters."""
    return "".join("ab"[i.bit_count() & 1] for i in range(1 << k))


def test_words_of_one_polynomial():
    for k in (9, 10, 11, 13):
        a = alternating(k).encode()
        b = a.translate(bytes.maketrans(b"ab", b"ba"))
        assert len(set(common.hashed_words([a + b" x " + b, a])[0].tolist())) == 3
        codes, words, per = common.word_codes([a, b, a])
        assert codes.tolist() == [0, 1, 0] and words == [a, b] and per.tolist() == [1, 1, 1]


def test_scoring_tells_long_words_apart(spark):
    a = alternating(11)
    texts = {i: f"x {a if i % 3 else a.translate(SWAP)} {a[: i + 1]}" for i in range(40)}
    tok = {i: [*t.split(), None] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tok}
    count = Counter(w for i in tok if not held[i] for w in tok[i])
    n, v = sum(count.values()), len(count)
    for r in scoring.score_texts(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect():
        assert (r.held_out, r.n_known, r.train_tokens) == (held[r.doc_id], sum(count[w] > 0 for w in tok[r.doc_id]), n)
        assert abs(r.base_score - sum(log10((count[w] + 1) / (n + v + 1)) for w in tok[r.doc_id])) < 1e-9
