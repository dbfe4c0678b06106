"""Company names, addresses, sizes and enrichment."""

from pyspark.sql import functions as F

from skillweft import dictionaries as d
from skillweft.functions import companies as cf
from skillweft.functions import html as ht
from skillweft.functions import sizes as sz
from skillweft.operators import companies as co
from skillweft.operators import rewrite as rw
from skillweft.operators.facets import present
from skillweft.plans import sqltext as q
from skillweft.plans.registry import query
from skillweft.roles import with_roles
from skillweft.sources.readers import spread

VALID = ", ".join(map(q.lit, sz.VALID_SIZES))
NAMES = """SELECT c_custkey, 'PT ' || replace(c_name, '#', ' ') || ' (' || c_mktsegment || ') | ' || c_mktsegment
    || '-Works Tbk' AS name FROM customer"""


def names(t):
    return t.texts("customer").select("c_custkey", F.concat(
        F.lit("PT "), F.replace(F.col("c_name"), F.lit("#"), F.lit(" ")), F.lit(" ("), "c_mktsegment", F.lit(") | "),
        "c_mktsegment", F.lit("-Works Tbk"),
    ).alias("name"))


@query("slugify", f"""
    SELECT c_custkey, name, trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM ({NAMES})""")
def slugify(t):
    return names(t).select("c_custkey", "name", cf.slugify(F.col("name")).alias("slug"))


_SUFFIXES = ", ".join(map(q.lit, d.CORPORATE_SUFFIXES))


@query("strip_company_suffixes", rf"""
    SELECT c_custkey, trim(regexp_replace(array_to_string(w, ' '),
               '^((pt|tbk) )+|( (pt|tbk))+$', '', 'g')) AS core
    FROM (SELECT c_custkey, list_filter(string_split_regex(lower(name), '[^a-z0-9]+'), lambda x: x <> '') AS w
          FROM ({NAMES}))""")
def strip_company_suffixes(t):
    return names(t).select("c_custkey", cf.strip_suffixes(F.col("name")).alias("core"))


@query("name_variants", rf"""
    SELECT DISTINCT c_custkey, trim(regexp_replace(v, '\s+', ' ', 'g')) AS variant
    FROM (SELECT c_custkey, unnest(list_concat([name], string_split_regex(name, '\s*[|/]\s*'),
              regexp_extract_all(name, '\(([^\)]+)\)', 1),
              [regexp_replace(name, '\([^\)]*\)', ' ', 'g'), replace(name, '-', ' ')],
              regexp_extract_all(name, '\b[A-Z]{{2,8}}\b'))) AS v FROM ({NAMES})) WHERE trim(v) <> ''""")
def name_variants(t):
    return names(t).select("c_custkey", F.explode(cf.name_variants(F.col("name"))).alias("variant"))


@query("slug_candidates", rf"""
    SELECT DISTINCT c_custkey, trim(regexp_replace(lower(x), '[^a-z0-9]+', '-', 'g'), '-') AS slug
    FROM (SELECT c_custkey, unnest([v, regexp_replace(trim(regexp_replace(lower(v), '[^a-z0-9]+', ' ', 'g')),
                 '^((pt|tbk) )+|( (pt|tbk))+$', '', 'g')]) AS x
          FROM (SELECT c_custkey, unnest(list_concat([name], string_split_regex(name, '\s*[|/]\s*'),
              regexp_extract_all(name, '\(([^\)]+)\)', 1),
              [regexp_replace(name, '\([^\)]*\)', ' ', 'g'), replace(name, '-', ' ')],
              regexp_extract_all(name, '\b[A-Z]{{2,8}}\b'))) AS v FROM ({NAMES})) WHERE trim(v) <> '')""")
def slug_candidates(t):
    return names(t).select("c_custkey", F.explode(cf.slug_candidates(F.col("name"))).alias("slug"))


@query("guessed_slugs", rf"""
    SELECT DISTINCT c_custkey, unnest([replace(clean, ' ', '-'), replace(short, ' ', '-'), split_part(short, ' ', 1),
                                       split_part(short, ' ', 1) || '-' || split_part(short, ' ', 2)]) AS slug
    FROM (SELECT c_custkey, clean, trim(regexp_replace(regexp_replace(clean, '\b(pt|tbk)\b', '', 'g'), '\s+', ' ', 'g')) AS short
          FROM (SELECT c_custkey, trim(regexp_replace(regexp_replace(lower(name), '[^a-z0-9\s-]', ' ', 'g'), '\s+', ' ', 'g')) AS clean
                FROM ({NAMES})))""")
def guessed_slugs(t):
    return names(t).select("c_custkey", F.explode(cf.guessed_slugs(F.col("name"))).alias("slug"))


# companies, addresses and page texts that take every branch of the checks: full, partly and wrongly named ones, legal
# forms alone, several parts, brackets, regions, blanks and pages that were not found
_FIRMS = """SELECT p_partkey AS id, w1 || ' ' || w2 AS both,
        CASE WHEN p_partkey % 53 = 0 THEN NULL ELSE CASE p_partkey % 7 WHEN 0 THEN 'PT ' || w1 || ' ' || w2 || ' Tbk'
            WHEN 1 THEN w1 || ' ' || w2 || ' ' || w3 WHEN 2 THEN w1 || ' ' || w2 || ' Indonesia'
            WHEN 3 THEN w1 || ' ' || w2 || ' | ' || w3 || ' Group' WHEN 4 THEN 'PT Tbk' WHEN 5 THEN ''
            ELSE w1 || '-' || w2 || ' (' || w3 || ' AG)' END END AS company,
        CASE WHEN p_partkey % 59 = 0 THEN NULL ELSE 'https://www.linkedin.com/company/' || CASE p_partkey // 7 % 6
            WHEN 0 THEN w1 || '-' || w2 WHEN 1 THEN w1 || '_' || w3 WHEN 2 THEN w2 WHEN 3 THEN 'other-firm'
            WHEN 4 THEN w1 || '-' || w2 || '-indonesia' ELSE '' END || '/' END AS company_url,
        CASE p_partkey // 42 % 6 WHEN 0 THEN 'Welcome to ' || upper(w1) || ' ' || w2 || ' ' || w3
            WHEN 1 THEN w1 || ' and others in Indonesia' WHEN 2 THEN w1 || ' ' || w2 WHEN 3 THEN w1 || ' ' || w2 || ': page not found'
            WHEN 4 THEN '' ELSE 'another firm' END AS page
    FROM (SELECT p_partkey, split_part(p_name, ' ', 1) AS w1, split_part(p_name, ' ', 2) AS w2, lower(p_type) AS w3 FROM part)"""


def firms(t):
    """The rows of ``_FIRMS``."""
    key, name = F.col("p_partkey"), F.col("p_name")
    w1, w2, w3 = F.split_part(name, F.lit(" "), F.lit(1)), F.split_part(name, F.lit(" "), F.lit(2)), F.lower("p_type")

    def one_of(number, *options):
        return F.get(F.array(*(o if not isinstance(o, str) else F.lit(o) for o in options)), (number % len(options)).cast("int"))

    def text(*parts):
        return F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))

    company = one_of(
        key, text("PT ", name, " Tbk"), text(name, " ", w3), text(name, " Indonesia"), text(name, " | ", w3, " Group"), "PT Tbk", "",
        text(w1, "-", w2, " (", w3, " AG)"))
    slug = one_of(F.floor(key / 7), text(w1, "-", w2), text(w1, "_", w3), w2, "other-firm", text(w1, "-", w2, "-indonesia"), "")
    page = one_of(
        F.floor(key / 42), text("Welcome to ", F.upper(w1), " ", w2, " ", w3), text(w1, " and others in Indonesia"), name,
        text(name, ": page not found"), "", "another firm")
    return t.table("part").select(
        key.alias("id"), F.when(key % 53 != 0, company).alias("company"),
        F.when(key % 59 != 0, text(d.COMPANY_URL_PREFIX, slug, "/")).alias("company_url"), page.alias("page"))


def _in(words):
    return "(" + ", ".join(map(q.lit, words)) + ")"


def _telling(name):
    return (f"list_filter(string_split_regex(lower({name}), '[^a-z0-9]+'), lambda w: length(w) > 1 "
            f"AND w NOT IN {_in([*d.CORPORATE_SUFFIXES, *d.IGNORED_NAME_WORDS])})")


_REGIONS = "[" + ", ".join(map(q.lit, d.REGIONAL_WORDS)) + "]"
# behind the last '/company/'; an address without a slug leaves '/company'
_SLUG = "lower(string_split(rtrim(regexp_extract(company_url, 'linkedin.com([^?#;]*)', 1), '/'), '/company/')[-1])"
_ALL_BUT_ONE = "hits >= greatest(1, n - 1)"


@query("slug_checks", rf"""
    WITH firm AS ({_FIRMS}), c AS (SELECT *, {_SLUG} AS slug FROM firm WHERE company IS NOT NULL AND company_url IS NOT NULL),
    loose AS (SELECT *, len(ws) AS n, len(list_filter(ws, lambda w: contains(translate(slug, '-_', '  '), w))) AS hits
        FROM (SELECT *, list_filter(string_split(lower(company), ' '), lambda w: length(w) > 1
                  AND w NOT IN {_in(d.SHORT_CORPORATE_SUFFIXES)}) AS ws FROM c)),
    form AS (SELECT id, slug, v, {_telling('v')} AS ws FROM (SELECT id, slug, unnest(list_concat([company],
            string_split_regex(company, '\s*[|/]\s*'), regexp_extract_all(company, '\(([^\)]+)\)', 1),
            [regexp_replace(company, '\([^\)]*\)', ' ', 'g'), replace(company, '-', ' ')],
            regexp_extract_all(company, '\b[A-Z]{{2,8}}\b'))) AS v FROM c) WHERE trim(v) <> ''),
    fit AS (SELECT id, bool_or(n > 0 AND CASE WHEN len(list_filter({_REGIONS}, lambda r: contains(lower(v), r))) > 0
            THEN hits >= n ELSE {_ALL_BUT_ONE} END) AS fits
        FROM (SELECT *, len(ws) AS n, len(list_filter(ws, lambda w: list_contains(string_split_regex(slug, '[^a-z0-9]+'), w))) AS hits
              FROM form) GROUP BY id),
    lead AS (SELECT id, string_split_regex(slug, '[^a-z0-9]+') AS sw, {_telling("string_split_regex(company, '[ ]*[|/][ ]*')[1]")} AS first FROM c)
    SELECT id, company, company_url, slug <> '' AND company <> '' AND (n = 0 OR {_ALL_BUT_ONE}) AS contains_name,
           slug <> '' AND coalesce(fits, false) AND (len(first) = 0 OR list_has_any(sw, first)) AS fits_name
    FROM loose JOIN lead USING (id) LEFT JOIN fit USING (id)""")
def slug_checks(t):
    rows = firms(t).filter(F.col("company").isNotNull() & F.col("company_url").isNotNull())
    return rows.select(
        "id", "company", "company_url",
        cf.slug_contains_name(F.col("company_url"), F.col("company")).alias("contains_name"),
        cf.slug_fits_name(F.col("company_url"), F.col("company")).alias("fits_name"),
    )


@query("name_checks", rf"""
    WITH firm AS ({_FIRMS}), c AS (SELECT *, lower(page) AS p, translate({_SLUG}, '-_/', '   ') AS slug,
            list_filter(regexp_extract_all(lower(company), '[a-z]{{3,}}'), lambda w: w NOT IN {_in(d.NAME_STOPWORDS)}) AS short,
            list_filter(regexp_extract_all(lower(company), '[a-z]{{4,}}'), lambda w: w NOT IN {_in(d.TITLE_STOPWORDS)}) AS long,
            {_telling('company')} AS ws, list_filter({_REGIONS}, lambda r: contains(lower(company), r)) AS regions
        FROM firm WHERE company IS NOT NULL AND company_url IS NOT NULL)
    SELECT id, len(short) = 0 OR len(list_filter(short, lambda w: contains(p, w))) >= least(2, len(short)) AS in_text,
           len(long) > 0 AND len(list_filter(long, lambda w: NOT contains(p, w))) = 0 AS in_title,
           p <> '' AND NOT contains(p, 'page not found') AND NOT contains(p, '404') AND slug <> '' AND n > 0
             AND CASE WHEN len(regions) > 0 THEN hits >= n AND len(list_filter(regions, lambda r: contains(p, r) OR contains(slug, r))) > 0
                 ELSE {_ALL_BUT_ONE} END AS fits_page
    FROM (SELECT *, len(ws) AS n, len(list_filter(ws, lambda w: contains(p, w) OR contains(slug, w))) AS hits FROM c)""")
def name_checks(t):
    rows = firms(t).filter(F.col("company").isNotNull() & F.col("company_url").isNotNull())
    page, company = F.col("page"), F.col("company")
    return rows.select(
        "id", cf.name_in_text(company, page).alias("in_text"), cf.title_names_company(page, company).alias("in_title"),
        cf.page_fits_name(F.col("company_url"), company, page).alias("fits_page"),
    )


@query("company_slugs", with_roles("""
    SELECT DISTINCT company_url, nullif(regexp_extract(company_url, '/company/([^/?#]+)', 1), '') AS slug,
           CASE WHEN company_url <> '' THEN company_url END AS canonical
    FROM jobs WHERE company_url IS NOT NULL""", "jobs"))
def company_slugs(t):
    urls = t.jobs.filter(F.col("company_url").isNotNull()).select("company_url").distinct()
    # a host without 'www' and tracking parameters must not change the canonical form
    tracked = F.when(F.col("company_url") != "", F.concat(
        F.replace(F.col("company_url"), F.lit("www."), F.lit("id.")), F.lit("?trk=x%20y"))).otherwise("")
    return urls.select(
        "company_url", cf.company_slug(F.col("company_url")).alias("slug"), cf.canonical_url(tracked).alias("canonical")
    )


@query("job_links", with_roles("SELECT id, link FROM postings", "postings"))
def job_links(t):
    raw = F.concat(F.lit("https://id.linkedin.com/jobs/view/data-engineer-at-x-"), "id", F.lit("?refId=7"))
    return t.postings.select("id", cf.job_url(raw).alias("link"))


@query("url_work_list", with_roles("""
    SELECT company, count(*) AS job_count FROM jobs
    WHERE company_url IS NULL AND company IS NOT NULL AND company NOT IN ('', 'N/A') GROUP BY ALL""", "jobs"))
def url_work_list(t):
    return co.url_work_list(t.jobs).orderBy(F.desc("job_count"), "company")


@query("size_work_list", with_roles(f"""
    SELECT company, company_url, employee_size, min(id) AS job_id, count(*) AS job_count FROM jobs
    WHERE employee_size IS NULL OR employee_size = '' OR employee_size NOT IN ({VALID}) GROUP BY ALL""", "jobs"))
def size_work_list(t):
    return co.size_work_list(t.jobs).orderBy(F.desc("job_count"), "job_id")


@query("company_without_size", with_roles("""
    SELECT company, min(company_url) AS company_url, count(*) AS job_count FROM jobs
    WHERE company <> '' AND (employee_size IS NULL OR employee_size = '') GROUP BY ALL""", "jobs"))
def company_without_size(t):
    return co.one_url_per_company(t.jobs)


@query("unique_companies", with_roles("""
    SELECT company, count(*) AS job_count FROM jobs WHERE company NOT IN ('', 'N/A') GROUP BY ALL""", "jobs"))
def unique_companies(t):
    return co.unique_companies(t.jobs).orderBy(F.desc("job_count"), "company")


@query("url_coverage", with_roles("""
    SELECT count(*) AS total, count(*) FILTER (company_url IS NULL) AS missing,
           round(100.0::DOUBLE * count(company_url) / count(*), 1) AS covered_pct FROM jobs""", "jobs"))
def url_coverage(t):
    return co.missing_url_counts(t.jobs)


@query("size_statistics", with_roles("""
    SELECT employee_size, count(*) AS jobs, count(DISTINCT company) AS companies,
           round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM jobs), 1) AS percentage
    FROM jobs GROUP BY employee_size""", "jobs"))
def size_statistics(t):
    return co.size_statistics(t.jobs)


@query("clean_sizes", with_roles(f"""
    SELECT id, CASE WHEN employee_size IN ({VALID}) THEN employee_size END AS employee_size FROM jobs""", "jobs"))
def clean_sizes(t):
    return t.jobs.select("id", co.clean_sizes(t.jobs).alias("employee_size"))


_MODE = """SELECT company, arg_min(employee_size, o) AS employee_size, max(cnt) AS cnt,
        arg_min(company_url, o) FILTER (company_url <> '') AS company_url
    FROM (SELECT *, row_number() OVER (ORDER BY -cnt, coalesce(company_url, ''), coalesce(employee_size, '')) AS o
          FROM (SELECT company, company_url, employee_size, count(*) AS cnt FROM jobs
                WHERE company NOT IN ('', 'N/A') GROUP BY ALL)) GROUP BY company"""


@query("main_size_per_company", with_roles("SELECT * FROM m", "jobs", m=_MODE))
def main_size_per_company(t):
    return co.main_size(t.jobs)


_VERIFIED = """SELECT replace(c_name, '#', ' ') AS company,
    CASE WHEN c_acctbal > 5000 THEN '10,001+' WHEN c_acctbal > 1000 THEN '1,001-5,000' ELSE '51-200' END AS size
    FROM customer WHERE c_mktsegment = 'BUILDING'"""


def verified(t):
    size = F.when(F.col("c_acctbal") > 5000, "10,001+").when(F.col("c_acctbal") > 1000, "1,001-5,000").otherwise("51-200")
    return t.table("customer").filter(F.col("c_mktsegment") == "BUILDING").select(
        F.replace(F.col("c_name"), F.lit("#"), F.lit(" ")).alias("company"), size.alias("size")
    )


_ORD = ("CASE replace({0}, ',', '') " + " ".join(f"WHEN '{label}' THEN {i}" for i, label in enumerate(sz.VALID_SIZES, 1))
        + " END")
_SUSPICIOUS = f"""SELECT company, company_url, employee_size, cnt, size AS verified_size,
    CASE WHEN size IS NOT NULL AND {_ORD.format('size')} IS DISTINCT FROM {_ORD.format('employee_size')} THEN 'verified'
         WHEN {_ORD.format('employee_size')} = 8 THEN CASE WHEN NOT {q.any_in('lower(company)', d.LARGE_COMPANY_WORDS)}
              THEN 'too_large' END
         WHEN {_ORD.format('employee_size')} IN (1, 2) AND len(string_split(company, ' ')) <= 3 THEN 'too_small' END AS reason
    FROM m LEFT JOIN v USING (company) WHERE employee_size IS NOT NULL AND employee_size NOT IN ('', 'N/A')"""


@query("suspicious_sizes", with_roles("SELECT * FROM s WHERE reason IS NOT NULL", "jobs", m=_MODE, v=_VERIFIED,
                                      s=_SUSPICIOUS))
def suspicious_sizes(t):
    return co.suspicious_sizes(t.jobs, verified(t))


@query("repair_sizes", with_roles("""
    SELECT j.id, coalesce(s.verified_size, j.employee_size) AS employee_size
    FROM jobs j LEFT JOIN (SELECT * FROM s WHERE reason = 'verified') s USING (company)""",
    "jobs", m=_MODE, v=_VERIFIED, s=_SUSPICIOUS))
def repair_sizes(t):
    return co.repair_sizes(t.jobs, verified(t)).select("id", "employee_size")


@query("repair_sizes_dry_run", with_roles("""
    SELECT j.company, count(*) AS rows FROM jobs j JOIN s USING (company) WHERE reason = 'verified' GROUP BY ALL""",
    "jobs", m=_MODE, v=_VERIFIED, s=_SUSPICIOUS))
def repair_sizes_dry_run(t):
    fixes = co.suspicious_sizes(t.jobs, verified(t)).filter(F.col("reason") == "verified")
    return rw.count_updates(t.jobs, fixes, "company")


_FOUND = f"""SELECT company, company_url, '201-500' AS employee_size FROM jobs
    WHERE employee_size IS NULL OR employee_size NOT IN ({VALID}) GROUP BY ALL"""


@query("propagate_sizes", with_roles("""
    SELECT j.id, coalesce(f.employee_size, j.employee_size) AS employee_size
    FROM jobs j LEFT JOIN f ON f.company = j.company AND f.company_url IS NOT DISTINCT FROM j.company_url""",
    "jobs", f=_FOUND))
def propagate_sizes(t):
    found = co.size_work_list(t.jobs).select("company", "company_url", F.lit("201-500").alias("employee_size"))
    return co.propagate_sizes(t.jobs, found).select("id", "employee_size")


FILL_URLS = with_roles("""
    SELECT id, CASE WHEN company_url IS NULL AND company NOT IN ('', 'N/A')
        THEN 'https://www.linkedin.com/company/' || lower(replace(company, ' ', '-')) || '/' ELSE company_url END AS company_url
    FROM jobs""", "jobs")


def found_urls(t):
    return co.url_work_list(t.jobs).select("company", F.concat(
        F.lit(d.COMPANY_URL_PREFIX), cf.slugify(F.col("company")), F.lit("/")).alias("company_url"))


@query("fill_urls", FILL_URLS)
def fill_urls(t):
    return co.fill_urls(t.jobs, found_urls(t)).select("id", "company_url")


_HIT = """SELECT arg_min(company, id) AS c, arg_min(coalesce(company_url, '?'), id) AS u FROM jobs
    WHERE contains(lower(company), 'customer 0000000')"""


@query("repair_one_company", with_roles("""
    SELECT id, CASE WHEN company = c AND coalesce(company_url, '?') = u THEN '11-50' ELSE employee_size END AS employee_size
    FROM jobs CROSS JOIN h""", "jobs", h=_HIT))
def repair_one_company(t):
    return co.repair_company(t.jobs, "Customer 0000000", "11-50").select("id", "employee_size")


@query("size_by_name", with_roles("""
    SELECT n.name, coalesce(
        (SELECT arg_min(employee_size, id) FROM known k WHERE k.text = lower(trim(n.name))),
        (SELECT arg_min(employee_size, id) FROM known k WHERE contains(k.text, lower(trim(n.name))))) AS size
    FROM n WHERE size IS NOT NULL""", "jobs",
    known="""SELECT lower(trim(company)) AS text, employee_size, id FROM jobs
             WHERE company <> '' AND employee_size <> ''""",
    n="""SELECT DISTINCT replace(c_name, '#', ' ') AS name FROM customer
         UNION SELECT DISTINCT substr(s_name, 10) FROM supplier"""))
def size_by_name(t):
    asked = t.table("customer").select(F.replace(F.col("c_name"), F.lit("#"), F.lit(" ")).alias("name")).union(
        t.table("supplier").select(F.substr("s_name", F.lit(10)).alias("name"))
    ).distinct()
    return co.size_by_name(asked, t.jobs)


@query("source_priority", with_roles("""
    SELECT company, coalesce(a, b, c) AS value,
           CASE WHEN a IS NOT NULL THEN 'cache' WHEN b IS NOT NULL THEN 'stored' ELSE 'parameter' END AS source
    FROM (SELECT company, min(a) AS a, min(b) AS b, min(c) AS c FROM (
            SELECT company_name AS company, nullif(employee_size, '') AS a, NULL AS b, NULL AS c FROM company_enrichment
            UNION ALL SELECT company, NULL, nullif(employee_size, ''), NULL FROM jobs
            UNION ALL SELECT company, NULL, NULL, size FROM v) GROUP BY company)
    WHERE coalesce(a, b, c) IS NOT NULL""", "jobs", "company_enrichment", v=_VERIFIED))
def source_priority(t):
    return co.by_source_priority([
        ("cache", t.company_enrichment.select(F.col("company_name").alias("company"), F.col("employee_size").alias("value"))),
        ("stored", t.jobs.select("company", F.col("employee_size").alias("value"))),
        ("parameter", verified(t).select("company", F.col("size").alias("value"))),
    ])


@query("enrich_companies", with_roles("""
    SELECT company_name, employee_size, linkedin_slug, source FROM company_enrichment
    UNION ALL SELECT company, (SELECT max(size) FROM v WHERE v.company = n.company),
                     nullif(regexp_extract(url, '/company/([^/?#]+)', 1), ''), 'enriched'
    FROM (SELECT company, arg_max(company_url, id) FILTER (company_url <> '') AS url FROM jobs
          WHERE company NOT IN ('', 'N/A') AND company NOT IN (SELECT company_name FROM company_enrichment)
          GROUP BY company) n""", "jobs", "company_enrichment", v=_VERIFIED))
def enrich_companies(t):
    sizes = verified(t).select("company", F.col("size").alias("employee_size"))
    return co.enrich(t.jobs, t.company_enrichment, sizes)


def job_pages(t):
    """A posting page per job that shows the company address in one of several ways.

    Some pages show another address than the stored one: a renamed or a foreign company.
    """
    stored = F.coalesce("company_url", F.lit(""))
    url = F.when((stored == "") | (F.col("id") % 7 != 3), stored).when(
        F.col("id") % 14 == 3, F.lit("https://www.linkedin.com/company/other-firm/")
    ).otherwise(F.replace(stored, F.lit("/company/"), F.lit("/company/new-")))
    key = F.col("id") % 5
    return spread(t.jobs, "id").select(F.col("id").alias("job_id"), F.concat(
        F.lit("<html><body><h1>Job</h1><a href='/jobs'>all</a>"),
        F.when(key == 0, F.concat(F.lit('<a class="x" href="'), url, F.lit('?lipi=1">c</a>')))
        .when(key == 1, F.concat(F.lit('<script type="application/ld+json">[{"a": 1}, {"hiringOrganization": {"url": "'),
                                 url, F.lit('"}}]</script>')))
        .when(key == 2, F.concat(F.lit('<meta content="'), url, F.lit('" property="og:url">')))
        .when(key == 3, F.concat(F.lit("<p>see "), url, F.lit(" now</p>")))
        .otherwise(F.lit("<p>none</p>")),
        F.lit("</body></html>"),
    ).alias("html"))


_LINKS = """SELECT id, company, company_url, found_url,
        CASE WHEN found_url IS NULL THEN 'none' WHEN id % 5 = 0 THEN 'direct_link' WHEN id % 5 = 1 THEN 'structured_data'
             WHEN id % 5 = 2 THEN 'og_meta' ELSE 'text_parse' END AS strategy,
        CASE WHEN found_url IS NULL THEN 0.0 WHEN id % 5 = 0 THEN 0.95 WHEN id % 5 = 1 THEN 0.85 ELSE 0.7 END::DOUBLE AS confidence,
        CASE WHEN found_url IS NOT NULL THEN coalesce(company LIKE 'Customer%' AND contains(found_url, 'customer-'), false) END AS valid,
        CASE WHEN found_url <> company_url THEN coalesce(company LIKE 'Customer%' AND contains(found_url, 'customer-'), false) END AS improvement
    FROM (SELECT *, CASE WHEN id % 5 = 4 OR coalesce(company_url, '') = '' THEN NULL WHEN id % 14 = 3 THEN 'https://www.linkedin.com/company/other-firm/'
              WHEN id % 7 = 3 THEN replace(company_url, '/company/', '/company/new-') ELSE company_url END AS found_url FROM jobs)"""


@query("extract_links", with_roles("SELECT * FROM l", "jobs", l=_LINKS))
def extract_links(t):
    return co.extract_links(t.jobs, job_pages(t))


@query("link_statistics", with_roles("""
    SELECT strategy, count(*) AS total, count(*) FILTER (valid) AS validated,
           count(*) FILTER (improvement) AS improved,
           round(100.0::DOUBLE * count(*) FILTER (valid) / count(*), 1) AS success_rate
    FROM l WHERE found_url IS NOT NULL GROUP BY strategy""", "jobs", l=_LINKS))
def link_statistics(t):
    return co.strategy_statistics(co.extract_links(t.jobs, job_pages(t)))


@query("apply_links", with_roles("""
    SELECT id, 'https://www.linkedin.com/company/' || lower(replace(company, ' ', '-')) || '/' AS company_url
    FROM jobs WHERE company LIKE 'Customer%'""", "jobs"))
def apply_links(t):
    """Pages carry the address of the company's name; stored addresses are replaced by it."""
    rows = t.jobs.filter(present("company", "N/A"))
    pages = rows.select(F.col("id").alias("job_id"), F.concat(
        F.lit('<a href="/company/'), cf.slugify(F.col("company")), F.lit('/about">About</a>')).alias("html"))
    return co.apply_links(rows, co.extract_links(rows, pages)).select("id", "company_url")


_SIZE_LABELS = ["1-10", "11-50", "51-200"]
_list_pick = "[" + ", ".join(f"'{x}'" for x in _SIZE_LABELS) + "][c_nationkey % 3 + 1]"


def _listed_size():
    return F.element_at(F.array(*map(F.lit, _SIZE_LABELS)), (F.col("c_nationkey") % 3 + 1).cast("int"))


PAGE_TEXT = r"""
    SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(
        regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', ' ', 'g'),
        '(?s)<[^>]*>', ' ', 'g'),
        '&quot;', '"'), '&#34;', '"'), '&#39;', ''''), '&apos;', ''''), '&lt;', '<'), '&gt;', '>'), '&nbsp;', ' '), '&amp;', '&'),
        '\s+', ' ', 'g')) AS text FROM pages"""


@query("href_scan", r"""
    SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\b[^>]*?\shref\s*=\s*"([^"]*)"', 1)) AS href FROM pages""")
def href_scan(t):
    return t.texts("pages").select("page_id", F.explode(ht.hrefs(F.col("html"))).alias("href"))


@query("page_text", PAGE_TEXT)
def page_text(t):
    return t.texts("pages").select("page_id", ht.visible_text(F.col("html")).alias("text"))


@query("page_login_walls", r"""
    SELECT page_id, length(t) < 120 OR """ + q.any_in("t", d.LOGIN_WALL_MARKERS) + r""" AS blocked
    FROM (SELECT page_id, lower(trim(regexp_replace(regexp_replace(html, '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))) AS t FROM pages)""")
def page_login_walls(t):
    text = F.regexp_replace("html", r"(?s)<[^>]*>", " ")
    return t.texts("pages").select("page_id", cf.is_login_wall(text).alias("blocked"))


@query("page_descriptions", f"""
    SELECT page_id, CASE page_id % 4 WHEN 0 THEN text WHEN 1 THEN CASE WHEN length(text) > 100 THEN text ELSE 'Short' || chr(10) || text END
        WHEN 2 THEN CASE WHEN length(text) > 100 THEN text ELSE repeat('b', 101) END ELSE 'Nothing marked' || chr(10) || text END AS description
    FROM ({PAGE_TEXT})""")
def page_descriptions(t):
    """Descriptions by selector, in their order and of more than 100 letters, else the main part."""
    text = F.replace(ht.visible_text(F.col("html")), F.lit("&"), F.lit("&amp;"))
    text = F.replace(text, F.lit("<"), F.lit("&lt;"))
    kind, filler = F.col("page_id") % 4, F.lit("b" * 101)
    body = (
        F.when(kind == 0, F.concat(F.lit('<main><div class="description">'), text, F.lit("</div></main>")))
        # the first selector holds too little
        .when(kind == 1, F.concat(F.lit('<main><div class="show-more-less-html__markup">Short</div><div class="x description">'),
                                  text, F.lit("</div></main>")))
        # an earlier selector stands later in the page
        .when(kind == 2, F.concat(F.lit('<section id="description">'), filler,
                                  F.lit('</section><div class="show-more-less-html__markup">'), text, F.lit("</div>")))
        .otherwise(F.concat(F.lit("<p>Menu</p><main><h1>Nothing marked</h1>"), text, F.lit("</main>")))
    )
    return t.texts("pages").select("page_id", ht.posting_description(body).alias("description"))


@query("company_page_sizes", f"""
    SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN CAST(n AS VARCHAR) WHEN 1 THEN '1-' || n WHEN 2 THEN n || '+' END AS size
    FROM (SELECT c_custkey, CAST(floor(abs(c_acctbal)) AS BIGINT) + 20 AS n FROM customer)""")
def company_page_sizes(t):
    """Head count in embedded data, else in one of the wordings of the page, else none."""
    n, kind = (F.floor(F.abs("c_acctbal")) + 20).cast("string"), F.col("c_custkey") % 4
    page = F.concat(
        F.lit("<html><body><h1>About us</h1>"),
        F.when(kind == 0, F.concat(F.lit('<script type="application/ld+json">{"@type":"Organization","numberOfEmployees": '),
                                   n, F.lit("}</script><p>Company size: 5 employees</p>")))
        .when(kind == 1, F.concat(F.lit("<p>Company size: 1-"), n, F.lit(" employees</p>")))
        .when(kind == 2, F.concat(F.lit("<div>Jumlah karyawan - "), n, F.lit("+ karyawan</div>")))
        .otherwise(F.lit("<p>We like tools</p>")),
        F.lit("<p>" + "Plain words fill the page. " * 8 + "</p></body></html>"),
    )
    return t.table("customer").select("c_custkey", ht.company_page_size(page).alias("size"))


@query("short_element_sizes", f"""
    SELECT c_custkey, CASE c_custkey % 3 WHEN 2 THEN NULL ELSE {_list_pick} END AS label FROM customer""")
def short_element_sizes(t):
    """Size labels in meta contents and short elements; long elements do not count."""
    label, kind = _listed_size(), F.col("c_custkey") % 3
    long_text = F.lit("this is a long line of words that goes on and on about ")
    page = F.when(kind == 0, F.concat(F.lit('<meta name="d" content="'), label, F.lit(' employees">'))).when(
        kind == 1, F.concat(F.lit("<ul><li>"), long_text, F.lit("1-10 employees</li><li><b>"), label, F.lit("</b> employees</li></ul>"))
    ).otherwise(F.concat(F.lit("<ul><li>"), long_text, label, F.lit(" employees</li></ul>")))
    return t.table("customer").select("c_custkey", ht.short_element_size(page).alias("label"))


_STAFF = "CAST(floor(abs(c_acctbal)) AS BIGINT)"


@query("page_sizes", f"""
    SELECT c_custkey, CASE WHEN n = 0 THEN NULL {" ".join(f"WHEN n <= {hi} THEN '{c}'" if hi else f"ELSE '{c}'"
        for (_, hi, _), c in zip(d.SIZE_RANGES, d.SIZE_LABELS_COMMA, strict=True))} END AS label,
        CAST(n AS VARCHAR) AS staff,
        {"CASE " + " ".join(f"WHEN n <= {hi} THEN '{c}'" if hi else f"ELSE '{c}'" for _, hi, c in d.SIZE_RANGES)} END AS code_label
    FROM (SELECT c_custkey, {_STAFF} AS n FROM customer)""")
def page_sizes(t):
    """Company pages with the head count as JSON field, as JSON-LD value and in a code tag."""
    n = F.floor(F.abs("c_acctbal")).cast("string")
    slug = F.concat(F.lit("c-"), F.col("c_custkey").cast("string"))
    ld = F.concat(F.lit('<script type="application/ld+json">{"@type":"Organization","numberOfEmployees": '), n,
                  F.lit("}</script>"))
    code = F.concat(
        F.lit('<code id="a">{&quot;included&quot;:[{&quot;universalName&quot;:&quot;other&quot;,'
              '&quot;employeeCountRange&quot;:{&quot;start&quot;:1,&quot;end&quot;:10}},{&quot;universalName&quot;:&quot;'),
        slug, F.lit('&quot;,&quot;entityUrn&quot;:&quot;urn:x&quot;,&quot;employeeCountRange&quot;:{&quot;start&quot;:'),
        n, F.lit(',&quot;end&quot;:99999}}]}</code>'),
    )
    page = F.concat(F.lit("<html><body>"), ld, code, F.lit("</body></html>"))
    return t.table("customer").select("c_custkey", page.alias("html"), slug.alias("slug")).select(
        "c_custkey", ht.field_size(F.col("html")).alias("label"), ht.json_ld_size(F.col("html")).alias("staff"),
        ht.code_tag_size(F.col("html"), F.col("slug")).alias("code_label"),
    )


@query("labelled_sizes", f"""
    SELECT c_custkey, CASE {" ".join(f"WHEN n <= {hi} THEN '{c}'" if hi else f"ELSE '{c}'"
        for (_, hi, _), c in zip(d.SIZE_RANGES, d.SIZE_LABELS_COMMA, strict=True))} END AS label
    FROM (SELECT c_custkey, {_STAFF} + 7 AS n FROM customer)""")
def labelled_sizes(t):
    """'Company size' terms for half of the companies, wording in the page text for the others."""
    n = F.format_number(F.floor(F.abs("c_acctbal")) + 7, 0)
    page = F.when(F.col("c_custkey") % 2 == 0, F.concat(
        F.lit("<dl><dt>Industry</dt><dd>Tools</dd><dt> Ukuran Perusahaan </dt><dd><b>1-"), n, F.lit("</b> karyawan</dd></dl>")
    )).otherwise(F.concat(F.lit("<p>We are a group of 1-"), n, F.lit(" employees</p>")))
    return t.table("customer").select("c_custkey", ht.labelled_size(page).alias("label"))
