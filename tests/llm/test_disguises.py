import numpy as np
import pytest

from kmerdex.llm import toxicity


@pytest.mark.parametrize("text", ["stuupid", "stu.pid", "stu-pid", "s..t..u..p..i..d", "s  t  u  p  i  d", "s\tt\tu\tp\ti\td", "s\nt\nu\np\ni\nd", "s t u p i d", "stuuupid"])
def test_spacing_and_repetition_are_decoded(text):
    counts = np.zeros((toxicity.SYMBOLS,) * 3)
    for w, n in (("stupid", 50), ("hello", 50), ("letter", 50)):
        s = [0, 0, *(toxicity.Decoder.symbol(x) for x in w), 0]
        for t in zip(s, s[1:], s[2:]):
            counts[t] += n
    reader = toxicity.Reader(toxicity.Decoder(counts), lambda words: tuple(words))
    assert "stupid" in {w for found in reader.text(text) for w in found}
    assert {w for found in reader.text("hello letter") for w in found} == {"hello", "letter"}
