import numpy as np

from tessella.llm import quality


def test_symbols_on_a_word_do_not_hide_it():
    hashes = quality.WordHashes()
    plain, _ = quality.features(b"the idiot said scum", hashes, 18)
    for text in (b"the idiot### said SCUM!!", b"'the' $$idiot$$ said, scum.", b"(The) *idiot* said: scum"):
        assert np.array_equal(quality.features(text, hashes, 18)[0], plain)
    assert len(quality.features(b"*** --- !", hashes, 18)[0]) == 3
    rng = np.random.default_rng(5)
    words = [f"w{i}".encode() for i in range(300)]
    texts = [b" ".join(rng.choice(words, 30)) + (b" idiot" if i % 2 else b"") for i in range(400)]
    model = quality.Ordinal.fit([quality.features(t, hashes, 18) for t in texts], np.array([0 if i % 2 else 2 for i in range(400)]), 18, 3)
    at, x = quality.features(b" ".join(rng.choice(words, 30)) + b" idiot### idiot###", hashes, 18)
    assert model.above(np.array([model.weights[at] @ x]))[0, 0] < 0.5
