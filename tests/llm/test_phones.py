"""Phone numbers of the explicit shape get pseudonyms outside the number plan too."""

from framequery.llm import pii


def test_phones_outside_the_plan():
    there, back = pii.replacer(b"k"), pii.replacer(b"k", True)
    for text in ("call +1 (017) 555-7713 now", "call +1 (212) 055-7713 now"):
        new, finds = there(text)
        assert new != text and [f[0] for f in finds] == ["phone"] and back(new)[0] == text
    assert there("call (017) 555-7713 now") == ("call (017) 555-7713 now", [])
