"""Findings of both sides: pairs are judged where they meet, evidence once a revision."""

import pytest

from pressdelta.operators import topics as TP
from pressdelta.plans import catalogue

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


@pytest.mark.parametrize("name", ["numeric_differences", "opposite_differences", "cross_media_differences", "pending_analysis_flagship"])
def test_no_pair_is_shuffled(spark, name):
    """Pairs were once shuffled to be grouped, and findings again to meet their evidence."""
    found = plan(catalogue.QUERIES[name](spark, SF))
    assert (found.count("Join"), found.count("Exchange"), found.count("Aggregate")) == (1, 2, 0)


@pytest.mark.parametrize("name", ["pending_analysis_flagship", "findings_view"])
def test_evidence_is_judged_once_a_revision(spark, name):
    """Every finding once redacted, parsed and judged the evidence of its peer anew."""
    found = plan(catalogue.QUERIES[name](spark, SF))
    assert "regexp" not in found.lower() and "python" not in found.lower()


def test_pairs_are_judged_after_the_window(spark):
    """What a pair differs in stays out of the join's condition, where each row of a bucket would be asked."""
    found = plan(catalogue.QUERIES["findings_view"](spark, SF))
    condition = next(line for line in found.splitlines() if "SortMergeJoin" in line)
    assert "array_min" not in condition and "transform" not in condition and "array_min" in found


def test_first_of_many_mentions(spark):
    """Numbers before antonyms, by place in the left text, then in the right one; once a pair."""
    say = lambda *parts: " ".join(f"Taipei Council harbour permit review {p}." for p in parts)
    texts = [say("approved", "7 vessels", "10 workers", "20 workers"), say("rejected", "5 workers", "3000 workers", "400 workers"), say("rejected", "9 tons"), say("closed", "10 workers")]
    rows = spark.createDataFrame([(i, f"https://m{i}.test/{i}", "Taipei notice", t, 1_700_000_000 + i) for i, t in enumerate(texts)], "revision_id long, url string, title string, text string, fetched_epoch long")
    want = {(0, 1, "10 workers", "5 workers"), (0, 2, "approved", "rejected"), (1, 0, "5 workers", "10 workers"), (2, 0, "rejected", "approved"), (1, 3, "5 workers", "10 workers"), (3, 1, "10 workers", "5 workers")}
    got = TP.differences(rows, ordered=False).select("left_id", "right_id", "left_claim", "right_claim").collect()
    assert len(got) == len(want) and set(map(tuple, got)) == want
