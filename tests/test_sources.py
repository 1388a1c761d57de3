import pytest

from galenic.sources import readers as R


def write(tmp_path, name, text, encoding="utf-8"):
    p = tmp_path / name
    p.write_bytes(text.encode(encoding))
    return str(p)


def test_directory_first_row_wins_and_lists_are_zipped(spark, tmp_path):
    head = "productndc\tPROPRIETARYNAME\tNONPROPRIETARYNAME\tDOSAGEFORMNAME\tROUTENAME\tLABELERNAME\tSUBSTANCENAME\tACTIVE_NUMERATOR_STRENGTH\tACTIVE_INGRED_UNIT\tNDC_EXCLUDE_FLAG\n"
    rows = ["0001-0001\tA\ta\tTABLET\tORAL\tX\tone; two\t5; 7\tmg/1; mg/mL\tN", "0001-0001\tB\tb\tTABLET\tORAL\tX\tone\t5\tmg\tN", "0002-0001\tC\tc\tTABLET\tORAL\tX\tone\t5\tmg\tY", "\tD\td\tTABLET\tORAL\tX\tone\t5\tmg\tN"]
    path = write(tmp_path, "p.txt", head + "\n".join(rows) + "\n")
    out = R.ndc_directory(spark, path).collect()
    assert [(r.product_ndc, r.brand, r.strength) for r in out] == [("0001-0001", "A", "5 mg / 7 mg/mL")]
    assert [tuple(x) for x in out[0].ingredients] == [("one", "5", "mg/1"), ("two", "7", "mg/mL")]
    assert R.ndc_directory(spark, path, with_delisted=True).count() == 2


def test_packages_need_their_product(spark, tmp_path):
    path = write(tmp_path, "k.txt", "PRODUCTNDC\tNDCPACKAGECODE\tPACKAGEDESCRIPTION\n1-1\t1-1-05\tx\n9-9\t9-9-01\ty\n")
    out = R.package_file(spark, path, spark.createDataFrame([("1-1",)], "product_ndc string")).collect()
    assert [tuple(r) for r in out] == [("1-1", "05", "x")]


def test_setid_map_keeps_the_latest_version(spark, tmp_path):
    path = write(tmp_path, "m.txt", "SETID|SPL_VERSION|RXCUI|RXSTRING|RXTTY\ns|1|10|old|SCD\ns|3|10|new|SCD\ns|x|11|b|SBD\n|1|1|a|SCD\n")
    out = R.setid_map(spark, path).collect()
    assert [(e.version, e.rxcui, e.name) for e in out[0].entries] == [(3, "10", "new"), (0, "11", "b")] and len(out) == 1


def test_registry_lines(spark, tmp_path):
    path = write(tmp_path, "r.txt", "# c\n\nAcme [Ac, Acme Labs] : 1, 22\nbad line\nOther : 22\n")
    codes, names = R.registry(spark, path)
    assert {tuple(r) for r in codes.collect()} == {("00001", "Acme"), ("00022", "Acme")}
    assert {tuple(r) for r in names.collect()} == {("acme", "Acme"), ("ac", "Acme"), ("acme labs", "Acme"), ("other", "Other")}


def test_labeler_json(spark, tmp_path):
    a = write(tmp_path, "a.json", '[{"Acme": {"codes": ["1", "2"], "full_name": "Acme Inc"}}, {"Zed": {"codes": ["2"]}}]')
    assert {(r.code, r.name) for r in R.labeler_list(spark, a).collect()} == {("1", "Acme"), ("2", "Zed")}
    b = write(tmp_path, "b.json", '{"1": {"name": "n"}, "2": {"name": "m", "full_name": "f"}}')
    assert {tuple(r) for r in R.labeler_object(spark, b).collect()} == {("1", "n"), ("2", "f")}


def test_encoding(spark, tmp_path):
    assert R.encoding_of(spark, write(tmp_path, "u.txt", "é")) == "UTF-8"
    assert R.encoding_of(spark, write(tmp_path, "w.txt", "é€", "cp1252")) == "windows-1252"


def test_bad_dates_fail_and_blank_ones_are_open(spark, tmp_path):
    head = "PRODUCTNDC\tPRODUCTTYPENAME\tSTARTMARKETINGDATE\tENDMARKETINGDATE\tNDC_EXCLUDE_FLAG\tLISTING_RECORD_CERTIFIED_THROUGH\n"
    good = write(tmp_path, "g.txt", head + "0012-1\tRX\t20200101\t\tN\t\n0013-1\tRX\t20990101\t\tN\t\n0014-1\tOTC\t\t\tN\t\n")
    out = R.strict_products(R.delimited(spark, good), "2024-06-01", ("RX",)).collect()
    assert [tuple(r) for r in out] == [("12", "0012-1")]
    bad = write(tmp_path, "b.txt", head + "0012-1\tRX\t2020-01\t\tN\t\n")
    with pytest.raises(Exception, match="bad STARTMARKETINGDATE"):
        R.strict_products(R.delimited(spark, bad), "2024-06-01", ("RX",)).collect()


def test_required_columns(spark, tmp_path):
    with pytest.raises(ValueError, match="PACKAGEDESCRIPTION"):
        R.package_file(spark, write(tmp_path, "k.txt", "PRODUCTNDC\tNDCPACKAGECODE\n1\t2\n"), spark.createDataFrame([("1",)], "product_ndc string"))


def test_json_sink(spark, tmp_path):
    R.write_json(spark.range(3), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 3
