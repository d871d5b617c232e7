import textwrap

import pytest
from quarry.llm import licenses


@pytest.mark.parametrize("width", [18, 40, 72])
@pytest.mark.parametrize("mark", ["", " * ", "// ", "# "])
@pytest.mark.parametrize("label, notice", licenses.TEMPLATES)
def test_wrapped(label, notice, mark, width):
    """A notice over several lines, behind and before other text, has its label, and all its words."""
    lines = textwrap.wrap("Some words before. " + notice + " and some words behind it", width)
    low = ("first line\n\n" + "\n".join(mark + x for x in lines) + "\n\nlast").encode().lower()
    found = licenses.Join({}).blocks(low, licenses.is_word())
    assert max(c for _, _, k, c in found if licenses.TEMPLATES[k][0] == label) >= licenses.THRESHOLD
    if not any(notice in x for x in lines):
        assert {licenses.TEMPLATES[k][0] for *_, k, _ in found} >= {label}


def test_far_words_are_no_notice():
    """Words of a notice that are spread over many lines don't make one."""
    low = b"\n".join(w + b" and much other text around it here" for w in b"released under the mit license".split())
    assert licenses.Join({}).blocks(low, licenses.is_word()) == []
