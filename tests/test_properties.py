"""Property tests: the Spark message normalisers equal a brute-force Python
evaluation of the same rule lists on random ASCII messages."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from logspark.functions import text as X

ALPHABET = "abcdefABCDEFxyzXYZ0123456789 ./:-_%=()"
messages = st.lists(st.text(alphabet=ALPHABET, max_size=60), min_size=1, max_size=40)


def py_error_pattern(m):
    for pat, rep in X.ERROR_PATTERN_RULES:
        m = re.sub(pat, rep, m)
    return m.strip()


def py_signature(m):
    s = m.lower()
    for pat, rep in X.SIGNATURE_RULES:
        s = re.sub(pat, rep, s)
    words = [w for w in re.findall(X.WORD3, s) if w not in X.SIGNATURE_STOP_WORDS]
    return " ".join(words[:5])


def py_cluster(m):
    return " ".join(sorted(set(re.findall(X.WORD4, m.lower())))[:3])


def py_response_time(m, mode):
    for pat in X.RESPONSE_TIME_PATTERNS:
        hit = re.search(pat, m, re.IGNORECASE)
        if hit:
            v = float(hit.group(1))
            if mode == "reference" or "duration" in pat:
                v *= 1000
            return v or None
    return None


def _spark_rows(spark, msgs, *cols):
    df = spark.createDataFrame([(i, m) for i, m in enumerate(msgs)], "i int, m string")
    return {r.i: tuple(r)[1:] for r in df.select("i", *cols).collect()}


@settings(max_examples=15, deadline=None)
@given(msgs=messages)
def test_normalisers_match_python(spark, msgs):
    got = _spark_rows(spark, msgs, X.error_pattern("m"), X.message_signature("m"), X.cluster_signature("m"))
    for i, m in enumerate(msgs):
        assert got[i] == (py_error_pattern(m), py_signature(m), py_cluster(m)), m


timings = st.lists(st.one_of(
    st.text(alphabet=ALPHABET, max_size=30),
    st.builds(lambda a, n, b: f"{a}took {n}ms{b}", st.text(alphabet="abc ", max_size=5),
              st.from_regex(r"[0-9]{1,4}(\.[0-9]{0,2})?", fullmatch=True), st.text(alphabet="abc ", max_size=5)),
    st.builds(lambda n, u: f"Duration:{u}{n}s", st.from_regex(r"[0-9]{1,3}(\.[0-9]{1,2})?", fullmatch=True),
              st.sampled_from(["", " ", "  "])),
    st.builds(lambda n: f"x time={n}ms", st.from_regex(r"[0-9]{1,3}", fullmatch=True)),
), min_size=1, max_size=30)


@settings(max_examples=15, deadline=None)
@given(msgs=timings)
def test_response_time_matches_python(spark, msgs):
    got = _spark_rows(spark, msgs, X.response_time("m", "intended"), X.response_time("m", "reference"))
    for i, m in enumerate(msgs):
        want = (py_response_time(m, "intended"), py_response_time(m, "reference"))
        g = got[i]
        assert (g[0] is None) == (want[0] is None) and (g[1] is None) == (want[1] is None), m
        if want[0] is not None:
            assert abs(g[0] - want[0]) < 1e-9 * max(1, want[0]) and abs(g[1] - want[1]) < 1e-9 * max(1, want[1]), m
