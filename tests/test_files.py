from ledgerwell.operators import ingest
from ledgerwell.sources import files


def put(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_register_from_csv(spark, tmp_path):
    reg = put(tmp_path / "r.csv", "Facility Name,State Name,District Name,Subdistrict Name,Facility Type,Location Type,Latitude,Longitude\n"
              "A, Assam ,Dibrugarh,,PHC,Rural,27.1,95.0\n,Delhi,,x, CHC ,Public,bad,77.1\nC,A & N Islands,South,,DIS_H,urban,11.6,92.7\n")
    pop = put(tmp_path / "p.csv", "State/ UT,Average Rural Population [Census 2011] covered by a Sub Centre,Average Rural Population [Census 2011] covered by a PHC,"
              "Average Rural Population [Census 2011] covered by a CHC\nAssam,5000,30000,150000\nDelhi,4000,20000,NA\nA & N Island,1000,8000,60000\nAll India,1,1,1\n")
    raw = files.facility_register(spark, reg)
    out = ingest.load_facilities(raw, ingest.population_lookup(files.population(spark, pop)), ("Assam",))
    got = {r.facility_id: r for r in out.collect()}
    assert sorted(got) == ["IN-0", "IN-1", "IN-2"]
    a, b, c = got["IN-0"], got["IN-1"], got["IN-2"]
    assert (a.name, a.admin_l1, a.facility_type, a.location_type, a.population_served, a.is_demo_facility) == ("A", "Assam", "phc", "rural", 30000, True)
    assert (b.name, b.admin_l2, b.location_type, b.latitude, b.population_served) == ("Unknown", "", None, None, None)
    assert (c.population_served, c.location_type) == (60000, "urban")      # alias of the state, hospital as CHC
    check = ingest.load_verify(out, raw)
    assert check.first().ok
    ingest.require(check)


def test_staffing_from_several_files(spark, tmp_path):
    head = "State/ UT,Required - [R],Sanctioned - [S],In Position - [P]\n"
    put(tmp_path / "doc.csv", head + "Assam,10,8,6\nDelhi,5,0,0\nGoa,NA,NA,3\nAll India,15,8,9\n")
    put(tmp_path / "nurse.csv", head + "Assam,10,4,5\nAll India/ Total,10,4,5\n")
    raw = files.staffing(spark, [str(tmp_path / "doc.csv"), str(tmp_path / "nurse.csv")])
    kinds = spark.createDataFrame([("doc.csv", "Doctor", ["phc"]), ("nurse.csv", "Nursing staff", ["phc", "chc"])],
                                  "source_file string, cadre string, applies_to_facility_types array<string>")
    got = {(r.state, r.cadre): (r.sanctioned, r.in_position, r.vacant, r.vacancy_rate) for r in ingest.load_staffing(raw, kinds, 2022).collect()}
    assert got == {("Assam", "Doctor"): (8, 6, 2, .25), ("Delhi", "Doctor"): (0, 0, 0, None), ("Goa", "Doctor"): (None, 3, None, None),
                   ("Assam", "Nursing staff"): (4, 5, -1, -.25)}
    assert {r.source_file: r.ok for r in ingest.staffing_self_check(raw).collect()} == {"doc.csv": True, "nurse.csv": True}


def test_second_country(spark, tmp_path):
    e = put(tmp_path / "e.csv", "CO_CNES;TP_UNIDADE;CO_MOTIVO_DESAB;NO_FANTASIA;CO_IBGE;NU_LATITUDE;NU_LONGITUDE\n"
            "0012;1;;Posto São José;310010;-19,5;-44,1\n0013;2;x;Fechado;310010;;\n0014;5;;Outro;310010;;\n0015;2;;;310020;-20,1;-45\n", "latin-1")
    c = put(tmp_path / "c.csv", "co_cnes,municipio,uf,lat,long\n12,Belo,MG,\"-19,9\",-43.9\n12,Other,MG,1,1\n")
    m = put(tmp_path / "m.csv", "id_municipality,year,population\n3100104,2022,5000\n3100104,2010,1\n")
    out = ingest.load_second_country(files.establishments(spark, e), files.coordinates(spark, c), files.municipalities(spark, m), demo=("Belo",))
    got = {r.facility_id: r for r in out.collect()}
    assert sorted(got) == ["BR-12", "BR-15"]
    a, b = got["BR-12"], got["BR-15"]
    assert (a.name, a.admin_l2, a.latitude, a.longitude, a.population_served, a.is_demo_facility) == ("Posto São José", "Belo", -19.9, -43.9, 5000, True)
    assert (b.name, b.latitude, b.longitude, b.population_served) == ("Unknown", -20.1, -45.0, None)


def test_lines_prices_and_export(spark, tmp_path):
    d = put(tmp_path / "list.txt", "4.2.1 Zinc Tablet 20 mg\n1 Tablet 0.50 1499(E) 30.03.2022\n")
    rows = ingest.price_rows(files.document_lines(spark, d)).collect()
    assert [(r.doc_id, r.medicine, r.form, r.price) for r in rows] == [("list.txt", "Zinc", "Tablet 20 mg 1 Tablet", .5)]
    p = put(tmp_path / "p.csv", "item_match,strength,unit,ceiling_price_inr\nZinc,x,tablet,0.5\nZin,x,tablet,9\n")
    assert [(r.ord, r.price) for r in files.ceiling_prices(spark, p).orderBy("ord").collect()] == [(0, .5), (1, 9.0)]
    for form in ("json", "csv"):
        files.write_rows(spark.range(3), str(tmp_path / form), form)
        assert spark.read.format(form).options(header=True).load(str(tmp_path / form)).count() == 3


def test_a_slice_is_replaced_and_the_rest_untouched(spark):
    from pyspark.sql import functions as F
    old = spark.createDataFrame([("Assam", 1.0), ("Delhi", 2.0), ("Delhi", 3.0)], "state string, value double")
    new = spark.createDataFrame([("Delhi", 9.0)], "state string, value double")
    part = F.col("state") == "Delhi"
    once = ingest.replace_slice(old, new, part)
    twice = ingest.replace_slice(once, new, part)
    assert sorted(once.collect()) == sorted(twice.collect()) == [("Assam", 1.0), ("Delhi", 9.0)]
    assert ingest.slice_guard(old, once, part, "value").first().untouched
    assert not ingest.slice_guard(old, new, part, "value").first().untouched
