"""The category domain and the rules that name its members."""

from labelproof.operators import categories
from labelproof.rules import categories as rules


def test_domain_lists_every_category_once_and_the_rest_last():
    names = categories.domain()
    assert len(names) == len(set(names)) and names[-1] == rules.OTHER
    assert {n for n, _ in categories.TAG_RULES} | {n for n, _ in categories.NAME_RULES} <= set(names)
    assert names[0] == categories.TAG_RULES[0][0]
