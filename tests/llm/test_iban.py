"""IBANs before capitals, digits and other IBANs; length by country; right boundary."""

from flowlab.llm import pii


def test_ibans_before_capitals_and_numbers(spark):
    de, spaced, gb, no, mt = "DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "GB29NWBK60161331926819", "NO9386011117947", "MT84MALT011000012345MTLCAST001S"
    good = [(f"{de} Bank", [de]), (f"to {spaced} Please", [spaced]), (f"{gb} 2024", [gb]), (f"{gb} 2024 was", [gb]), (f"IBAN {spaced} end", [spaced]),
            (f"{de} {gb} X {no}", [de, gb, no]), (f"{no} 12 34 AB", [no]), (f"{mt}.", [mt]), (f"é漢😀 {spaced} BIC COBADEFF", [spaced]),
            (f"AB12 CD34 EF56 {de} OK", [de])]
    bad = [f"{de}1", f"{de}Bank", "DE89370400440532013001 Bank", f"{de[:-1]}", "A1" * 40, "AA11" * 500, "", None]
    rows = [(i, t) for i, t in enumerate([t for t, _ in good] + bad)]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    got = {r["doc_id"]: [r["text"][s["start"]:s["end"]] for s in r["pii_spans"] if s["kind"] == "iban"] for r in pii.find_pii(df).collect()}
    assert got == {i: w for i, w in enumerate([w for _, w in good] + [[]] * len(bad))}
    masked = {r["doc_id"]: r["text"] for r in pii.mask_pii(df).collect()}
    assert masked[0] == "<IBAN> Bank" and masked[1] == "to <IBAN> Please" and masked[2] == "<IBAN> 2024"
