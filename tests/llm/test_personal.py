import __spark_entry__ as e
from codelens.llm.personal import masked

TEXTS = {
    1: "Signed-off-by: Elif S. Penmarley <penmarley26@example.org>\nmailto:ines [at] dornar.example\ncc Petra Novarberg, p.n at mail dot cornar dot example",
    2: "Call +1 (725) 555-0182.\nmobile=1-555-0156 ext. 496\nTel. 030/23125081\nSeen in build 187-578-5145. Bound to 192.0.2.14:1593 since 2021-07-17T10:22:11Z.",
    3: '"SSN" = "914-56-5388"\nmy national insurance no. QQ 00 72 21 C, please\n身份证号 99533119861114139X',
    4: "--\n澹台知远\n云港市青榆区长堤大道284号9栋508室\nOffice: Flat 25, 46 Lindel Mews, Astrup QZ8 1BE\nTollingstraße 67b, 23153 Quenby",
    5: "Remote is git@wenhal.example:duncor/decoder.git now. Pin @wenfin/writer@7.72.6. icon@2x.png. I ping @narmi83. The Pewter Street dashboard.",
}
WANT = {
    (1, "person", "Elif S. Penmarley"), (1, "email", "penmarley26@example.org"), (1, "email", "ines [at] dornar.example"), (1, "person", "Petra Novarberg"), (1, "email", "p.n at mail dot cornar dot example"),
    (2, "phone", "+1 (725) 555-0182"), (2, "phone", "1-555-0156 ext. 496"), (2, "phone", "030/23125081"),
    (3, "id_number", "914-56-5388"), (3, "id_number", "QQ 00 72 21 C"), (3, "id_number", "99533119861114139X"),
    (4, "person", "澹台知远"), (4, "address", "云港市青榆区长堤大道284号9栋508室"), (4, "address", "Flat 25, 46 Lindel Mews, Astrup QZ8 1BE"), (4, "address", "Tollingstraße 67b, 23153 Quenby"),
}


def test_p10_kinds_and_values(spark, tmp_path):
    spark.createDataFrame(list(TEXTS.items()), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {tuple(r) for r in e.queries()["p10_found"](spark, str(tmp_path)).collect()} == WANT


def test_masked_keeps_the_rest():
    assert masked("cc Petra Novarberg, p@cornar.example now") == "cc <person>, <email> now"
