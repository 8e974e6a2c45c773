"""Values end where they end, and base spans hide none; all substitutions in brief items are seen."""

from itertools import combinations

import pytest

from fernlake.llm import decontaminate, secret_scan


@pytest.mark.parametrize(
    "text, want",
    [
        ('{"password":"hT7#kQ!9zW@4","token":"0123456789abcdef0123"}', '{"password":"[secret]","[secret]"}'),
        ("?pwd=hT7#kQ!9zW@4&sid=0123456789abcdef01234567", "?pwd=[secret]&sid=[secret]"),
        ("password: Abcdefghijkl!Zx9#qW$7", "[secret]"),
        ('{"pwd":"abc","secret":"Zx9#qW$7Lm!2"}', '{"pwd":"abc","secret":"[secret]"}'),
        ("pwd='it's9#kQ!zW4x' ok", "pwd='[secret]' ok"),
        ("pwd=Zx9?qW=7Lm!2", "pwd=[secret]"),
        ('secret: pwd: "Xk93#vQz!8Lp2"', 'secret: pwd: "[secret]"'),
        ("token=0123456789abcdef0123", "[secret]"),
    ],
)
def test_values_beside_base_spans_are_redacted(text, want):
    assert secret_scan.redact(text) == want


@pytest.mark.parametrize("size", range(8, 14))
def test_every_substitution_of_a_brief_item_is_seen(size):
    item = decontaminate.words(" ".join(f"w{i}" for i in range(size)))
    known = {h for h, _ in decontaminate.item_seeds(item)}
    for changed in combinations(range(size), size - -(-size * 4 // 5)):
        text = " ".join("other" if i in changed else f"w{i}" for i in range(size))
        assert known & {h for h, _ in decontaminate.item_seeds(decontaminate.words(text))}, changed
