"""Company names, addresses and pages."""

import random

import pytest
from pyspark.sql import functions as F

from skillweft.functions import companies as cf
from skillweft.functions import html as ht
from skillweft.operators import companies as co
from skillweft.plans import companies as plans
from skillweft.roles import Roles

SITE = "https://www.linkedin.com/company/"


def one(spark, expression, *values):
    names = [f"x{i}" for i in range(len(values))]
    row = spark.createDataFrame([values], ", ".join(f"{n} string" for n in names))
    return row.select(expression(*map(F.col, names)).alias("y")).first().y


@pytest.mark.parametrize("url, want", [
    (SITE + "shopee/", SITE + "shopee/"), ("https://linkedin.com/company/shopee", SITE + "shopee/"),
    ("/company/shopee/", SITE + "shopee/"), (SITE + "shopee?lipi=abc", SITE + "shopee/"),
    ("//linkedin.com/company/google/", SITE + "google/"), ("https://id.linkedin.com/company/a%2Db", SITE + "a-b/"),
    ("https://example.com/", None), ("", None), (None, None),
])
def test_canonical_url(spark, url, want):
    assert one(spark, cf.canonical_url, url) == want


def test_company_url_keeps_path(spark):
    assert one(spark, cf.company_url, "https://id.linkedin.com/company/a/about/?x=1") == SITE + "a/about/"
    assert one(spark, cf.company_url, "/company/a") is None


@pytest.mark.parametrize("slug, name, want", [
    ("google", "Google Inc", True), ("shopee", "Shopee Indonesia", True), ("microsoft-azure", "Microsoft Azure", True),
    ("xyz-random", "Google Inc", False), ("anything", "PT", True),
])
def test_slug_contains_name(spark, slug, name, want):
    assert one(spark, cf.slug_contains_name, f"{SITE}{slug}/", name) is want


@pytest.mark.parametrize("slug, name, want", [
    ("devoteam", "Devoteam | Google Cloud Partner", True), ("shopee", "Shopee Indonesia", False),
    ("shopee-indonesia", "Shopee Indonesia", True), ("acme", "Other Acme Tools", False), ("other-acme", "Other Acme Tools", True),
])
def test_slug_fits_name(spark, slug, name, want):
    assert one(spark, cf.slug_fits_name, f"{SITE}{slug}/", name) is want


def test_names(spark):
    assert one(spark, cf.strip_suffixes, "PT. Bank Central Asia Tbk") == "bank central asia"
    assert one(spark, cf.strip_suffixes, "PT Tbk") == "PT Tbk"
    assert one(spark, cf.slugify, "  Foo & Bar, Inc. ") == "foo-bar-inc"
    variants = one(spark, cf.name_variants, "Asia Pulp-Paper (APP) / Sinar Mas")
    assert variants == ["Asia Pulp-Paper (APP) / Sinar Mas", "Asia Pulp-Paper (APP)", "Sinar Mas", "APP",
                        "Asia Pulp-Paper / Sinar Mas", "Asia Pulp Paper (APP) / Sinar Mas"]
    assert one(spark, cf.guessed_slugs, "PT Indofood CBP Sukses Makmur Tbk - Noodle Division") == [
        "pt-indofood-cbp-sukses-makmur-tbk-noodle-division", "indofood-cbp-sukses-makmur-noodle", "indofood", "indofood-sukses"]
    assert one(spark, cf.name_in_text, "PT Bank Mandiri Tbk", "bank mandiri is large") is True
    assert one(spark, cf.title_names_company, "Profile of Mandiri", "Bank Mandiri") is False


def test_page_fits_name(spark):
    fits = lambda url, name, text: one(spark, cf.page_fits_name, url, name, text)
    assert fits(SITE + "acme/", "Acme Tools", "Welcome to Acme") is True
    assert fits(SITE + "acme/", "Acme Tools Indonesia", "Welcome to Acme Tools") is False
    assert fits(SITE + "acme/", "Acme Tools", "Page not found") is False


LINK = f'<html><body><a href="{SITE}shopee/">Shopee</a></body></html>'
JSONLD = f"""<script type="application/ld+json">
{{"@type": "JobPosting", "hiringOrganization": {{"name": "IBM", "organizer": {{"url": "{SITE}ibm/"}}}}}}</script>"""


@pytest.mark.parametrize("page, url, strategy", [
    (LINK, SITE + "shopee/", "direct_link"), (JSONLD, SITE + "ibm/", "structured_data"),
    (LINK + JSONLD, SITE + "shopee/", "direct_link"),
    ('<a href="/company/google/">G</a><a href="/company/shopee/">S</a>', SITE + "google/", "direct_link"),
    ('<a href="/company/company-name-with-dashes/">C</a>', SITE + "company-name-with-dashes/", "direct_link"),
    (f'<meta property="og:url" content="{SITE}x/">', SITE + "x/", "og_meta"),
    (f"see {SITE}y now", SITE + "y/", "text_parse"),
    ('<script type="application/ld+json">{invalid json</script>', None, None), ("", None, None), (None, None, None),
])
def test_company_link(spark, page, url, strategy):
    got = one(spark, ht.company_link, page)
    assert (got and got.url, got and got.strategy) == (url, strategy)


def test_cards(spark):
    page = """<ul><li><a class="base-card__full-link" href="https://id.linkedin.com/jobs/view/x-at-y-42?r=1&amp;t=2"></a>
      <h3 class="base-search-card__title"> Data <b>Engineer</b> </h3><h4 class="base-search-card__subtitle"><a>Acme</a></h4>
      <span class="job-search-card__location">Bogor</span><time datetime="2024-02-03"></time></li><li>ad</li></ul>"""
    got = one(spark, ht.posting_cards, page)
    assert [c.asDict() for c in got] == [{"href": "https://id.linkedin.com/jobs/view/x-at-y-42?r=1&t=2", "title": "Data Engineer",
                                         "company": "Acme", "location": "Bogor", "date": "2024-02-03"}]


def test_description(spark):
    long = "word " * 30
    assert one(spark, ht.posting_description, f'<div class="description">short</div><main> a <p>b</p></main>') == "a\nb"
    assert one(spark, ht.posting_description, f'<div class="show-more-less-html__markup"><p>{long}</p><p>end</p></div>') == long.strip() + "\nend"


def test_staff_text(spark):
    assert one(spark, ht.company_page_size, "<p>About us. Company size: 51-200 employees</p>") == "51-200"
    assert one(spark, ht.company_page_size, "<p>Sign in to see 51-200 employees</p>") is None
    assert one(spark, ht.json_ld_size, '<script type="application/ld+json">[{"x":1},{"employees":"1,200 employees"}]</script>') == "1,200"
    assert one(spark, ht.short_element_size, "<li>About 51-200 employees</li>") == "51-200"


def test_improvement(spark):
    rows = spark.createDataFrame(
        [(1, None, None, True), (2, "a", None, True), (3, "a", "a", True), (4, "b", "a", False), (5, "b", "a", True)],
        "i int, found string, stored string, valid boolean")
    got = rows.select(cf.is_improvement(F.col("found"), F.col("stored"), F.col("valid")).alias("y")).collect()
    assert [r.y for r in got] == [None, True, None, False, True]


def test_sizes_spread_to_all_jobs(spark):
    jobs = spark.createDataFrame(
        [(1, "A", None, None), (2, "A", "u", None), (3, "A", None, "1-10"), (4, "B", None, None)],
        "id int, company string, company_url string, employee_size string")
    found = spark.createDataFrame([("A", None, "11-50")], "company string, company_url string, employee_size string")
    got = {r.id: r.employee_size for r in co.propagate_sizes(jobs, found).collect()}
    assert got == {1: "11-50", 2: None, 3: "11-50", 4: None}
    filled = spark.createDataFrame([("A", "w")], "company string, company_url string")
    assert {r.id: r.company_url for r in co.fill_urls(jobs, filled).collect()} == {1: "w", 2: "u", 3: "w", 4: None}


def test_audit(spark):
    jobs = spark.createDataFrame(
        [(1, "Acme Corp", None, "10,001+"), (2, "Bank X", None, "10,001+"), (3, "Tiny", "u", "1-10"),
         (4, "Known", None, "51-200"), (5, "Same", None, "501-1000"), (6, "A B C D", None, "1-10")],
        "id int, company string, company_url string, employee_size string")
    verified = spark.createDataFrame([("Known", "11-50"), ("Same", "501-1,000")], "company string, size string")
    got = {r.company: r.reason for r in co.suspicious_sizes(jobs, verified).collect()}
    assert got == {"Acme Corp": "too_large", "Tiny": "too_small", "Known": "verified"}


def test_plain_pages_are_read_like_any_other():
    """The short way through a page of plain markup finds the elements and texts that the parser finds."""

    class Parsed(ht._Page):
        def _read_plain(self, html):
            return False

    plain = ['<li class="a b">', "</li>", "<a href=\"/x?a=1&amp;b=2\" >", "</a>", "<br>", " text ", "a &amp; b", "a & b", "<!-- c -->",
             "<!doctype html>", '<P CLASS="X" class="y">', "</P>", '<img src="x">', "\n", '<h3\n  x-y="&#39;">', "</h3>", "\u00e9"]
    other = ["<br/>", "<!-- a > b -->", "<script>", "</script>", "if (a<b)", "<p", "<p a=1>", "<p a='x'>", "</ p>", "<", "> >", "<3",
             "<title>", "</title>", "<x:y>", "&#65", "&#65;", "<![CDATA[x]]>", "<?p?>", "<input disabled>"]
    rng, short = random.Random(3), 0
    for n in range(4000):
        page = "".join(rng.choices(plain if n % 2 else plain + other, k=rng.randint(1, 12)))
        got, want = ht._Page().read(page), Parsed().read(page)
        assert (got.elements, got.texts) == (want.elements, want.texts), page
        short += ht._Page()._read_plain(page)
    assert short > 1500


def test_names_of_a_file_with_one_split_are_worked_on_by_every_core(spark, tmp_path):
    spark.range(200).select(
        F.col("id").alias("c_custkey"), F.concat(F.lit("Customer#"), "id").alias("c_name"), F.lit("FOOD").alias("c_mktsegment")
    ).coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    slugs = plans.slug_candidates(Roles(spark, str(tmp_path)))
    assert slugs.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert slugs.filter("c_custkey = 7 and slug = 'customer-7-food'").count() == 1


def test_only_attributes_that_cards_need_are_read(monkeypatch):
    """A page's tags keep their attributes as text until one is asked for."""
    read, pattern = [], ht._ATTRIBUTES

    class Counted:
        def findall(self, text):
            read.append(text)
            return pattern.findall(text)

    monkeypatch.setattr(ht, "_ATTRIBUTES", Counted())
    other = '<div class="nav"><a class="x" href="/y">z</a><span id="s">t</span></div>' * 20
    card = ('<li class="c"><div class="b"><a class="q base-card__full-link" href="/jobs/view/1?a=1&amp;b=2">o</a>'
            '<h3 CLASS="base-search-card__title"> T &amp; U </h3><h4 class="base-search-card__subtitle"><a href="/c">C</a></h4>'
            '<span class="other">x</span><span class="job-search-card__location"> P</span><time datetime="2024-01-02">n</time></div></li>')
    assert ht._cards(other + "<ul>" + card + "</ul>" + other) == [
        {"href": "/jobs/view/1?a=1&b=2", "title": "T & U", "company": "C", "location": "P", "date": "2024-01-02"}]
    assert len(read) == 5
