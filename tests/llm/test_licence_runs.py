"""Licences within lines, over several lines and over many paragraphs, inside longer texts."""

import random

import pytest

from assayer.llm import license

MATCHER = license.Matcher(license.templates(), license.THRESHOLD)
PROSE = [" ".join(f"word{(k * j) % 97}" for j in range(1, 30)) for k in range(1, 40)]


def laid_out(text, width=70):
    """The text in paragraphs of some sentences, each wrapped."""
    out, line = [], ""
    for w in text.split():
        line = f"{line} {w}".strip()
        if len(line) > width:
            out.append(line)
            line = ""
            if len(out) % 5 == 4:
                out.append("")
    return "\n".join([*out, line])


@pytest.mark.parametrize("lic", ["0BSD", "AGPL-3.0", "Apache-2.0", "BSL-1.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-3.0", "MIT", "Unlicense", "Zlib"])
def test_a_licence_with_blank_lines_in_a_long_document(lic):
    body = max((t for k, t in license.templates() if k == lic), key=len)
    text = "\n\n".join([*PROSE, f"Copyright (c) 2020 Some One\n\n{laid_out(body)}", *PROSE])
    assert license.scan_text(text, MATCHER)[:2] == (lic, 1.0)


def test_the_complete_isc_text():
    isc = max((t for k, t in license.templates() if k == "ISC"), key=len)
    assert isc.endswith("USE OR PERFORMANCE OF THIS SOFTWARE.") and license.scan_text(isc, MATCHER)[:2] == ("ISC", 1.0)


@pytest.mark.parametrize("lic", ["MIT", "ISC", "Zlib", "BSD-3-Clause"])
def test_a_licence_within_one_long_line(lic):
    body = max((t for k, t in license.templates() if k == lic), key=len)
    words = [f"word{(k * 31) % 997}" for k in range(300)]
    assert license.scan_text(" ".join([*words, body, *words]), MATCHER) == (lic, 1.0, 0)


def test_a_notice_in_mid_sentence():
    text = "Hello reader. This work is licensed under the MIT License, see below for what that means to you and to all others who copy it."
    assert license.scan_text(text, MATCHER) == ("MIT", 1.0, 0)
    assert license.scan_text("Hello reader. This work is written under the old oak tree, see below.", MATCHER)[0] is None


@pytest.mark.parametrize("lic", ["Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0"])
def test_whole_texts(lic):
    """The whole licence on one line between prose, one of its words in fifty replaced, without its end that names it."""
    body = max((t for k, t in license.templates() if k == lic), key=len).split()
    body = ["odd" if k % 50 == 7 else w for k, w in enumerate(body[: len(body) * 9 // 10])]
    prose = [f"word{(k * 31) % 997}" for k in range(2000)]
    got = license.scan_text(" ".join([*prose, *body, *prose]), MATCHER)
    assert got[0] == lic and got[1] > 0.85


def test_runs_against_all_runs():
    """Every run of words with every template, over texts of a few words in all orders."""
    rnd = random.Random(5)
    pairs = [("A", "a b c d e f"), ("B", "c d a b"), ("C", "f e d c b a a c e"), ("D", "b a")]
    m = license.Matcher(pairs, 0.6)
    hits = 0
    for _ in range(1500):
        lines = [" ".join(rnd.choice("abcdefxy") if rnd.random() < 0.5 else rnd.choice(["a b c", "c d", "d e f"]) for _ in range(rnd.randrange(4))) for _ in range(rnd.randrange(1, 9))]
        words, best = " ".join(lines).split(), None
        for i in range(len(words)):
            for j in range(i + 2, len(words) + 1):
                own = license.bigrams(" ".join(words[i:j]))
                for lic, t in pairs:
                    dice = 2 * len(own & license.bigrams(t)) / (len(own) + len(license.bigrams(t)))
                    if dice >= 0.6 and (best is None or (-dice, lic) < (-best[0], best[1])):
                        best = dice, lic
        got = license.scan_text("\n".join(lines), m)
        assert got[:2] == ((best[1], best[0]) if best else (None, 0.0))
        hits += best is not None
    assert 300 < hits < 1500
