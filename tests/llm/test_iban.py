"""Account numbers before capitals, currency codes and numbers."""

import pytest

from pressdelta.llm import pii

DE, DE4, GB, NO = "DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32", "NO9386011117947"
CASES = [
    (f"{DE4} Please pay", [DE4]),
    (f"{DE} EUR 500", [DE]),
    (f"{GB} BIC ABCD", [GB]),
    (f"{DE} 2024", [DE]),
    (f"{NO} {DE4} {GB} 2024 EUR", [NO, DE4, GB]),
    (f"IBAN {DE}, and ({GB}).", [DE, GB]),
    (f"{DE} A1 B2 C3 D4 E5 F6 G7 H8 I9", [DE]),
    (f"AB12 3456 789 {DE} Q", [DE]),
    (f"{DE}x {DE}7 x{DE}", []),
    ("DE89370400440532013001 EUR", []),
]


@pytest.mark.parametrize("text,want", CASES)
def test_account_numbers_end_where_they_end(spark, text, want):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    spans = [s.split(":") for s in pii.pii_digest(docs).first().spans.split(",") if s.startswith("iban")]
    assert [text[int(a) : int(b)] for _, a, b in spans] == want
    masked = text
    for w in want:
        masked = masked.replace(w, "[IBAN]", 1)
    if want:
        assert pii.mask_pii(docs).first().text == masked
