"""How much language ID holds at once."""

import numpy as np
import pytest

from eventmill.llm import langid


def test_features_of_few_words_are_held_at_once(monkeypatch):
    rng = np.random.default_rng(5)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, 7)) for _ in range(30_000)]
    model = langid.fit([(["one", "two", "of"], "en"), (["eins", "zwei", "der"], "de")] * 4)
    sizes, plain = [], langid.Crf.emissions
    monkeypatch.setattr(langid.Crf, "emissions", lambda self, ws: sizes.append(len(ws)) or plain(self, ws))
    text = " ".join(words)
    got = langid.label([text, "one two", text], model)
    assert max(sizes) <= 5_000 and sum(sizes) >= len(set(words))
    assert got[0] == (got[2][0], pytest.approx(got[2][1]), pytest.approx(got[2][2])) and got[0][0] in ("de", "en") and got[1][0] == "en"


@pytest.mark.parametrize("runs", [False, True])
def test_the_last_text_of_a_batch_can_fill_it(runs):
    model = langid.fit([(["one", "two", "of"], "en"), (["eins", "zwei", "der"], "de")] * 4)
    texts = ["one two of", "", "eins zwei", None, "der zwei of one two", "12", "one"]
    plain = [langid.label([t], model, runs=runs)[0] for t in texts]
    for most in range(1, 16):  # words told at once; some leave no text for the end
        for n in range(len(texts) + 1):
            got = langid.label(texts[:n], model, most_words=most, runs=runs)
            assert [g[0] for g in got] == [p[0] for p in plain[:n]]
            assert [g[1:3] for g in got] == [pytest.approx(p[1:3]) for p in plain[:n]]
            assert [[(r["start"], r["end"], r["lang"]) for s in g[3:] for r in s] for g in got] == [[(r["start"], r["end"], r["lang"]) for s in p[3:] for r in s] for p in plain[:n]]


def test_features_of_many_words_are_those_of_each():
    rng = np.random.default_rng(6)
    ranges = [(97, 123), (0xE0, 0x17F), (0x7F0, 0x810), (0x4E00, 0x4E40), (0xFFF0, 0x10020), (0x20000, 0x20020), (0xD7F8, 0xE008)]
    words = ["", "a", "ab", "abc", "abcd", "e\u0301", "\ud800x", "z" * 999]
    for _ in range(4000):
        lows = [ranges[k] for k in rng.integers(0, len(ranges), rng.integers(1, 3))]
        words.append("".join(chr(rng.integers(*lows[k % len(lows)])) for k in range(rng.integers(0, 14))))
    lexicons = {w: int(k) for w, k in zip(words[::7], rng.integers(0, 1 << 5, len(words)))}
    flat, ends = langid.features_of(words, lexicons)
    want = [langid.word_features(w, lexicons) for w in words]
    assert ends.tolist() == np.cumsum([len(x) for x in want]).tolist()
    assert flat.tolist() == [f for x in want for f in x]
    assert [x.tolist() for x in langid.features_of([], lexicons)] == [[], []]
    assert langid.features_of([""], {})[0].tolist() == langid.word_features("", {})


def test_places_of_words():
    rng = np.random.default_rng(7)
    texts = ["", "a", " a", "İİ x", "²a½b_c5d٣e", "\ud800a\udfffb"] + ["".join(map(chr, rng.integers(0, top, 400))) for top in (128, 0x250, 0x3000, 0x110000) for _ in range(50)]
    for t in texts:
        lower = t.lower()
        source = [k for k, c in enumerate(t) for _ in c.lower()]
        want = [(m[0], source[m.start()], source[m.end() - 1] + 1) for m in langid._WORD.finditer(lower)]
        assert [(w, *p) for ws, at in langid._placed(t) for w, p in zip(ws, at.tolist(), strict=True)] == want


def test_letters_of_few_words_are_held_at_once(monkeypatch):
    rng = np.random.default_rng(9)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, n)) for n in [900] * 400 + [5] * 6000 + [1500] * 3]
    model = langid.fit([(["one", "two", "of"], "en"), (["eins", "zwei", "der"], "de")] * 4)
    letters, plain = [], langid.features_of
    monkeypatch.setattr(langid, "features_of", lambda ws, lexicons: letters.append(sum(map(len, ws))) or plain(ws, lexicons))
    got = langid.label([" ".join(words)], model)
    assert max(letters) <= 101_000 and sum(letters) == sum(len(w) for w in set(words) if len(w) < 1000) and got[0][0] in ("de", "en")
