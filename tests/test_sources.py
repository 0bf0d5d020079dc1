import json
import zipfile

from bibliolith.operators import documents, normalize, packages, tables
from bibliolith.sources import exports, files, pubmed, remote
from bibliolith.streaming.cubes import maintain

WORK = {
    "id": "https://openalex.org/W9", "doi": "https://doi.org/10.1/x", "title": None, "display_name": "T", "publication_year": 2020,
    "cited_by_count": 7, "fwci": 1.1, "citation_normalized_percentile": {"value": 0.93, "is_in_top_10_percent": True},
    "authorships": [{"author": {"id": "https://openalex.org/A1", "display_name": " Ana "}, "countries": ["MX"],
                     "institutions": [{"id": "https://openalex.org/I1", "display_name": "U", "ror": "https://ror.org/1", "type": "education", "country_code": "MX"}]}],
    "primary_location": {"source": {"id": "https://openalex.org/S1", "display_name": "J", "type": "journal", "is_in_doaj": True}, "license": "cc-by"},
    "open_access": {"is_oa": True, "oa_status": "diamond"}, "apc_paid": {"value_usd": 10.0}, "grants": [{"funder_display_name": "F"}],
    "sustainable_development_goals": [{"id": "https://metadata.un.org/sdg/7", "display_name": "Energy"}], "referenced_works": ["https://openalex.org/W1"],
}


def test_nested_json_in_its_three_shapes(spark, tmp_path):
    for name, value in {"list": [WORK, WORK], "results": {"results": [WORK]}, "one": WORK}.items():
        path = tmp_path / f"{name}.json"
        path.write_text(json.dumps(value))
        rows = files.load(spark, str(path)).collect()
        assert len(rows) == (2 if name == "list" else 1)
        row = rows[0]
        assert (row["id"], row["title"], row["author_names"], row["country_codes"], row["is_doaj_indexed"]) == ("W9", "T", ["Ana"], ["MX"], 1)
        assert (row["percentile"], row["funder_names"], row["referenced_works"], row["sdg_ids"]) == (0.93, ["F"], ["W1"], ["7"])


def test_csv_headings_and_separators(spark, tmp_path):
    path = tmp_path / "upload.csv"
    path.write_text('Accession Number;Article Title;Authors;Year;Times Cited\nX1;A title;"Perez, J; Lopez, M";Nov 2020;n/a\nX2;B;Perez, Lopez;abc;5\nX3;C;Smith 3rd, J;2001;6\n')
    rows = {r["id"]: r for r in files.load(spark, str(path)).collect()}
    assert rows["X1"]["author_names"] == ["Perez, J", "Lopez, M"] and rows["X1"]["publication_year"] == 2020 and rows["X1"]["cited_by_count"] == 0
    assert rows["X2"]["author_names"] == ["Perez", "Lopez"] and rows["X2"]["publication_year"] == 0
    assert rows["X3"]["author_names"] == ["Smith 3rd, J"] and rows["X3"]["cited_by_count"] == 6


def test_rows_without_any_key_get_one(spark):
    made = normalize.normalize(spark.createDataFrame([("a",), ("b",)], "Title string"))
    assert made.select("id").distinct().count() == 2


def test_standard_columns_are_filled(spark):
    made = normalize.normalize(spark.createDataFrame([("W1", "a")], "id string, Title string"))
    kinds = dict(made.dtypes)
    for kind, names in normalize.STANDARD_COLUMNS.items():
        assert all(n in kinds for n in names.split())
        assert kind != "array<string>" or all(kinds[n] == kind for n in names.split())
    row = made.first()
    assert (row["author_names"], row["source_id"], row["abstract"], row["is_retracted"], row["doi"]) == ([], "", None, 0, "")


def test_pubmed_files(spark, tmp_path):
    good = (
        "<PubmedArticle><MedlineCitation><PMID>11</PMID><Article><ArticleTitle>Hi <i>x</i> y</ArticleTitle><Journal><Title>J</Title><JournalIssue>"
        "<PubDate><MedlineDate>2019 Jan-Feb</MedlineDate></PubDate></JournalIssue></Journal><Abstract><AbstractText Label='A'>one</AbstractText>"
        "<AbstractText Label='B'>two</AbstractText></Abstract><AuthorList><Author><LastName>Ruiz</LastName><ForeName>Eva</ForeName>"
        "<Identifier Source='ORCID'>https://orcid.org/0000-1</Identifier><AffiliationInfo><Affiliation>Hospital General, Ciudad de Mexico, Mexico.</Affiliation>"
        "</AffiliationInfo></Author></AuthorList></Article><MeshHeadingList><MeshHeading><DescriptorName>Lung</DescriptorName>"
        "<QualifierName MajorTopicYN='Y'>x</QualifierName></MeshHeading></MeshHeadingList></MedlineCitation><PubmedData><ArticleIdList>"
        "<ArticleId IdType='doi'>10.1/a</ArticleId></ArticleIdList></PubmedData></PubmedArticle>"
    )
    (tmp_path / "set.xml").write_text(f"<PubmedArticleSet>{good}<PubmedArticle><broken></PubmedArticle>{good.replace('>11<', '>12<')}</PubmedArticleSet>")
    rows = sorted(pubmed.read_xml(spark, str(tmp_path / "set.xml")).collect(), key=lambda r: r["pmid"])
    assert [r["pmid"] for r in rows] == ["11", "12"]
    row = rows[0]
    assert (row["title"], row["publication_year"], row["abstract"]) == ("Hi x y", 2019, "A: one\nB: two")
    assert (row["author_names"], row["author_ids"], row["all_country_codes"]) == (["Ruiz, Eva"], ["0000-1"], ["MX"])
    assert row["institution_names"] == ["Hospital General"] and row["mesh_headings"][0]["major_topic"] and row["doi"] == "10.1/a"


def test_remote_brackets_and_merge(spark):
    hits = {y: 3000 for y in range(2000, 2004)}
    count = lambda a, b: sum(hits[y] for y in range(a, b + 1))
    assert remote.year_brackets(count, 2000, 2003, 5000) == [(2000, 2000), (2001, 2001), (2002, 2002), (2003, 2003)]

    def fetch(query, a, b, at, n):
        entries = [{"eid": f"e{y}-{k % 2}"} for y in range(a, b + 1) for k in range(4)]
        return entries[at : at + n], len(entries)

    assert remote.harvest(spark, fetch, "q", 2000, 2001, page=3, most=4).count() == 4


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("W1", "a")], "id string, raw_data string")
    assert exports.write_parquet(df, str(tmp_path / "p")) and not exports.write_parquet(df.where("false"), str(tmp_path / "q"))
    exports.write_csv(df, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 1
    exports.write_works(df, str(tmp_path / "w"))
    assert spark.read.parquet(str(tmp_path / "w/works")).columns == ["id"]
    assert len(spark.read.parquet(str(tmp_path / "w/documents")).columns) == 29
    files_ = [("manifest.json", None), ("A Trend.csv", "trend"), ("A 2011-2015.csv", "periods"), ("A.csv", "full"), ("A Matrix.csv", "matrix"), ("A.parquet", "data")]
    for name, _ in files_:
        (tmp_path / name).write_text(name)
    (tmp_path / "more").mkdir()
    (tmp_path / "more/A.csv").write_text("second of its place")
    listed = [exports.PackageFile(str(tmp_path / n), k) for n, k in [*files_, ("more/A.csv", "full"), ("missing.csv", "full"), ("A.csv", "full")]]
    placed = exports.write_archive(listed, str(tmp_path / "z.zip"))
    assert [p.split("_")[0] for p in placed] == ["manifest.json", "04", "02", "03", "01", "05"]
    with zipfile.ZipFile(tmp_path / "z.zip") as z:
        assert z.namelist() == placed and z.read("03_Historico_Completo/A.csv") == b"A.csv"
    assert exports.sheet_name("a:b/" + "c" * 40) == "a-b-" + "c" * 27


def test_manifest_and_tagged_text_come_back(spark, tmp_path):
    exports.write_manifest(str(tmp_path / "manifest.json"), name="Año", periods=[(2011, 2015)], folder=tmp_path)
    back = json.loads((tmp_path / "manifest.json").read_text(encoding="utf-8"))
    assert back == {"name": "Año", "periods": [[2011, 2015]], "folder": str(tmp_path)}
    lines = spark.createDataFrame([("PMID- 1\nTI  - Título",), ("PMID- 2",)], "record string")
    exports.write_text(lines, str(tmp_path / "t"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "t")).collect()) == ["PMID- 1", "PMID- 2", "TI  - Título"]


def test_json_lines(spark, tmp_path):
    (tmp_path / "w.jsonl").write_text("\n".join(json.dumps({"id": f"https://openalex.org/W{k}", "title": "T", "publication_year": "2020"}) for k in range(3)))
    rows = files.load(spark, str(tmp_path / "w.jsonl")).collect()
    assert sorted(r["id"] for r in rows) == ["W0", "W1", "W2"] and (rows[0]["title"], rows[0]["publication_year"]) == ("T", 2020)


def test_countries_of_affiliations():
    told = {
        "Kyiv, Ukraine": "UA", "Indiana University, Bloomington, Indiana": None, "UNAM, Ciudad de México, México": "MX", "Charité, Berlin, Alemania": "DE",
        "Univ. of London, UK.": "GB", "Lab, Santo Domingo, República Dominicana": "DO", "Mexico City, Mexico. Electronic address: a@b.org": "MX",
        "Albuquerque, New Mexico, USA": "US", "Mexico, one, two, three, four": None, "": None, ".,;": None, "Seoul, South Korea": "KR",
    }
    assert {a: pubmed.country_of(a) for a in told} == told


def test_title_case_of_document_kinds(spark):
    kinds = ["reference-entry", "book chapter", "o'brien 2nd", "ARTICLE", "éa-ñu", ""]
    df = spark.createDataFrame([(k,) for k in kinds], "k string")
    assert [r[0] for r in df.select(documents.title_case(df.k)).collect()] == [k.title() for k in kinds]


def test_first_row_of_a_key(spark):
    df = spark.createDataFrame([("a", "x", 3), ("a", "y", 1), (None, "x", 2), (None, None, 9), (None, None, 9)], "k string, d string, n int")
    got = sorted(map(tuple, tables.dedup_by_first_key(df, ["k", "d"], ["n"]).collect()), key=str)
    assert got == sorted([("a", "y", 1), (None, "x", 2), (None, None, 9), (None, None, 9)], key=str)


def test_document_cells(spark):
    df = spark.createDataFrame([("['a', 'b ']", "1", None, 0.5), ("plain", "1", "9", 50.0)], "t string, f string, l string, p double")
    rows = df.select(documents.joined_text(df.t), documents.pages(df.f, df.l), documents.percentile(df.p)).collect()
    assert [tuple(r) for r in rows] == [("a; b", "1", 50.0), ("plain", "1-9", 50.0)]


def test_preview_makes_numbers_finite(spark):
    df = spark.createDataFrame([("b", float("nan")), ("A", float("inf")), ("c", 1.0)], "n string, x double")
    assert [tuple(r) for r in tables.preview(df, sort="n").collect()] == [("A", None), ("b", None), ("c", 1.0)]


def test_package_and_stream(spark, sf_dir, tmp_path):
    from bibliolith.plans.testworks import works

    rows = works(spark, sf_dir)
    written = packages.write_package(rows, str(tmp_path / "pkg"), [(1995, 1997)], ["locations", "Concepts"])
    assert len(written) == 6 and "Documents" in spark.read.parquet(str(tmp_path / "pkg/Locations Full")).columns
    assert [e.slug for e in packages.chosen(["nonsense"])][0] == "corpus"
    placed = exports.write_archive(written, str(tmp_path / "pkg.zip"))
    assert len(placed) == 6 and placed[0] == "03_Historico_Completo/Locations Full.parquet"
    with zipfile.ZipFile(tmp_path / "pkg.zip") as z:
        z.extractall(tmp_path / "out")
    for file, place in zip(written, placed):  # every table of the package comes back
        assert spark.read.parquet(str(tmp_path / "out" / place)).count() == spark.read.parquet(file.path).count() > 0
    rows.limit(50).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    maintain(stream, "sources", str(tmp_path / "cube"), str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "cube")).selectExpr("sum(doc_count)").first()[0] == 50


def test_articles_are_parsed_once_and_few_at_a_time(spark):
    xml = "<PubmedArticle><MedlineCitation><PMID>7</PMID><Article><ArticleTitle>x</ArticleTitle></Article></MedlineCitation></PubmedArticle>"
    rows = pubmed.records(spark.createDataFrame([(xml,), ("<PubmedArticle>",)], "xml string"))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BatchEvalPython") == 1 and "ArrowEvalPython" not in plan  # before, twice and in batches of 10,000
    assert [(r["pmid"], r["publication_year"], r["history_dates"]) for r in rows.collect()] == [("7", 0, {})]
