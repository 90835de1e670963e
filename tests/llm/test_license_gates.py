"""Gates only save time: with and without them the same licenses are found."""
from re import _constants as c
from re import _parser

import pytest

from ledgerspark.llm import licenses

EDGE = {c.CATEGORY_SPACE: "\n", c.CATEGORY_DIGIT: "1", c.CATEGORY_WORD: "w"}


def examples(items) -> list[str]:
    """Texts that a parsed pattern matches: one for each alternative, white space as a
    line break, optional pieces left out."""
    out = [""]
    for op, arg in items:
        if op is c.LITERAL:
            more = [chr(arg)]
        elif op is c.ANY:
            more = ["x"]
        elif op is c.IN:
            more = [EDGE[v] if kind is c.CATEGORY else chr(v) for kind, v in arg]
        elif op is c.SUBPATTERN:
            more = examples(arg[3])
        elif op is c.BRANCH:
            more = [x for part in arg[1] for x in examples(part)]
        elif op in (c.MAX_REPEAT, c.MIN_REPEAT):
            more = [x * arg[0] for x in examples(arg[2])]
        else:
            more = [""]
        out = [a + b for a in out for b in more]
    return out


def ungated(text):
    low = text.lower()
    return licenses.suppress([(priority, m.start(), m.end(), label) for label, priority, pattern, _ in licenses.rules()
                              for m in pattern.finditer(low)])


def test_gated_and_ungated_detections_agree():
    for label, priority, pattern, gate in licenses.rules():
        texts = [f". {x} ." for x in examples(_parser.parse(pattern.pattern))]
        assert gate and any(pattern.search(t) for t in texts), (label, priority)
        for t in texts[:60]:
            assert licenses.detect(t) == ungated(t), (label, t)


@pytest.mark.parametrize("text,label", [
    ("released under GPLv3", "gpl-3"), ("runs on FreeBSD", "bsd-2"), ("the simplified BSD", "bsd-2"), ("WTFPL", "wtfpl"),
    ("see mozilla.org/MPL/2.0", "mpl-2"), ("eclipse.org/legal/epl-2.0", "epl-2"), ("https://scripts.sil.org/OFL", "ofl"),
    ("wtfpl.net", "wtfpl"), ("creativecommons.org/publicdomain/zero", "cc0"), ("same terms as Perl itself", "artistic-2"),
    ("altered source versions must be plainly marked as such", "zlib"),
    ("placed in the public\ndomain", "public-domain"), ("All rights\nreserved", "all-rights-reserved")])
def test_licenses_without_a_common_word(text, label):
    assert [d[3] for d in licenses.detect(text)] == [label]
