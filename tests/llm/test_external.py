from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from quarry.llm import external


@settings(max_examples=60, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("ab", max_size=14).map(str.encode), min_size=1, max_size=7))
def test_transform_and_common_prefixes(tmp_path_factory, texts):
    """Against sorting all suffixes: equal ones go by their document's place; the end of a document has nothing in common."""
    files, rounds = external.build(texts, str(tmp_path_factory.mktemp("bwt")))
    assert rounds == max(map(len, texts))
    suffixes = sorted((t[k:], d, len(t) - k) for d, t in enumerate(texts) for k in range(len(t) + 1))
    got = [x for first in range(257) for x in zip(*(files.read(first, k).tolist() for k in ("document", "length", "symbols", "common")))]
    assert [(d, n) for d, n, _, _ in got] == [(d, n) for _, d, n in suffixes]
    assert [s for _, _, s, _ in got] == [texts[d][-n - 1] + 1 if n < len(texts[d]) else 0 for _, d, n in suffixes]
    shared = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    assert [c for *_, c in got] == [shared(suffixes[i][0], suffixes[i - 1][0]) if i else 0 for i in range(len(suffixes))]


@settings(max_examples=40, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("abc", max_size=25).map(str.encode), min_size=1, max_size=6))
def test_repeated_windows(tmp_path_factory, texts):
    files, _ = external.build(texts, str(tmp_path_factory.mktemp("bwt")))
    seen = Counter(t[k : k + 4] for t in texts for k in range(len(t) - 3))
    assert [x.tolist() for x in external.repeated_starts(files, texts, 4)] == [[k for k in range(len(t) - 3) if seen[t[k : k + 4]] > 1] for t in texts]
