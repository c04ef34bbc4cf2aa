import numpy as np

from quillpress.llm.toxicity import pieces_of, train

from .test_toxicity import SMALL, corpus


def test_pieces_hold_every_byte_of_a_long_word():
    rng = np.random.default_rng(3)
    for n in (39, 40, 41, 45, 50, 51, 60, 99, 1000):
        word = bytes(rng.integers(97, 123, n, dtype=np.uint8))
        got = pieces_of(b"short " + word + b" end")
        assert got[0] == b"short" and got[-1] == b"end"
        if n <= 40:
            assert got[1:-1] == [word]
        else:
            assert all(any(word[i : i + 10] in p for p in got) for i in range(n - 9)) and max(map(len, got)) <= 20 and len(got) < n / 10 + 4


def test_an_insult_in_the_middle_of_a_long_word_is_scored():
    """Texts without spaces between words, as in Chinese, Japanese or Thai."""
    texts, labels = corpus(400)
    glued = [x.replace(b" ", b"") for x in texts]
    scorer = train(glued, labels, SMALL).start()
    held, truth = corpus(100, seed=1)
    got = np.array([scorer.score(x.replace(b" ", b"")) for x in held])
    assert ((got >= 0.7) == np.array(truth)).mean() >= 0.9
    clean = b"alphabravorivermaple" * 20
    assert scorer.score(clean + b"blockheadnitwit" + clean) > scorer.score(clean + clean)


def test_scores_of_whole_words_are_learnt_as_before():
    texts, labels = corpus(200)
    scorer = train(texts, labels, SMALL).start()
    hidden = b"x" * 30 + b"blockheadnitwitblockhead" + b"x" * 30
    assert scorer.score(b"alpha " + hidden) > scorer.score(b"alpha " + b"x" * 84)
