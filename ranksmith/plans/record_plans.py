"""Resumes with experience, education, projects and certificates in varied layouts, read back as records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ranksmith.operators import resumes as P
from ranksmith.session import dealt, table

from .catalogue import query

TITLES = ("Data Engineer", "Software Developer", "Project Manager", "QA Tester", "Sales Intern")
PLACES = ("Pune", "Berlin", "Paris")


def resume_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): a resume for each customer with a job for each order, six layouts of jobs, three of degrees and of projects."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.struct("o_orderkey", F.col("o_orderdate").cast("date").alias("day"), "o_orderstatus", "o_orderpriority").alias("o"))
    nations = table(spark, sf_dir, "nation").select("n_nationkey", F.initcap("n_name").alias("home"))
    homes = table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "home")
    # little data, much reading: the keys are dealt to all cores before the texts are made, so that no text is shuffled
    customers = dealt(homes, "c_custkey")
    rows = customers.join(orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list("o")).alias("jobs")), F.col("c_custkey") == F.col("o_custkey"), "left")
    home, key = F.col("home"), F.col("c_custkey")
    letter = lambda i: F.char(65 + i % 26)
    title = lambda i: F.element_at(F.array(*map(F.lit, TITLES)), (i % 5 + 1).cast("int"))

    def job(o, i):
        company = F.concat(home, F.lit(" "), letter(i), F.lit(" Systems"))
        span = F.concat(F.date_format(o["day"], "MMM yyyy"), F.lit(" - "), F.when(o["o_orderstatus"] == "O", F.lit("Present")).otherwise(F.date_format(F.add_months(o["day"], 14), "MMM yyyy")))
        place, kind = F.element_at(F.array(*map(F.lit, PLACES)), (o["o_orderkey"] % 3 + 1).cast("int")), o["o_orderkey"] % 6
        cat = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
        head = (
            F.when(kind == 0, cat(company, "\n", title(i), "\n", span))
            .when(kind == 1, cat(title(i), " at ", company, " | ", span))
            .when(kind == 2, cat(title(i), ", ", company, ", ", span))
            .when(kind == 3, cat(company, " | ", title(i), " | ", span))
            .when(kind == 4, cat(company, ", ", place, "\n", title(i), "\n", span))
            .otherwise(cat(title(i), "\n", company, "\n", span))
        )
        return cat(head, "\n- Built ", F.lower(o["o_orderpriority"]), " stores\n  and kept them\n• Tested all")

    jobs = F.array_join(F.transform(F.coalesce("jobs", F.array().cast("array<struct<o_orderkey:bigint,day:date,o_orderstatus:string,o_orderpriority:string>>")), job), "\n")
    mark = (key % 10).cast("string")
    degrees = F.when(key % 3 == 0, F.concat(F.lit("B.Tech in Computer Science\n"), home, F.lit(" College\n2010 - 2014\nCGPA: "), mark, F.lit(".5/10\n"))).when(key % 3 == 1, F.concat(home, F.lit(" University 2010-2014 MBA Town School 2008 HSC 9"), mark, F.lit("%\n"))).otherwise(F.concat(F.lit("Ph.D, University of "), home, F.lit(", 2015\nM.Sc Information Technology\n")))
    projects = F.when(key % 3 == 0, F.concat(F.lit("Project: "), home, F.lit(" Store\n- Built it for all.\nProject: Second Shop\n- Wrote more."))).when(key % 3 == 1, F.concat(home, F.lit(" Store | Go, Rust • Built it for all. Second Shop | SQL • Wrote more."))).otherwise(F.concat(home, F.lit(" Store 2021 Built it for all. Second Shop 2022 Wrote more.")))
    certificates = F.concat(F.lit("AWS Cloud-\nFoundations "), mark, F.lit("\n12 badges\nScrum Master("), home, F.lit(")"))
    text = F.concat_ws("\n", F.lit("Ann Example"), F.lit("Work Experiance:"), jobs, F.lit("EDUCATION"), degrees, F.lit("Projects"), projects, F.lit("Certificates"), certificates)
    return rows.select(key.alias("doc_id"), text.alias("text"))


@query(
    f"""WITH c AS (SELECT c_custkey AS doc_id, array_to_string(list_transform(string_split(n_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS home FROM customer JOIN nation ON c_nationkey = n_nationkey),
o AS (SELECT o_custkey AS doc_id, o_orderkey, o_orderdate::DATE AS day, o_orderstatus, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i FROM orders),
jobs AS (SELECT doc_id, 'job' AS kind, i, home || ' ' || chr(CAST(65 + i % 26 AS INT)) || ' Systems' AS a, {list(TITLES)}[i % 5 + 1] AS b, strftime(day, '%b %Y') AS c, CASE WHEN o_orderstatus = 'O' THEN 'Present' ELSE strftime(day + INTERVAL 14 MONTH, '%b %Y') END AS d,
  CASE WHEN i % 5 = 4 THEN 'Internship' ELSE 'Full-time' END || '|' || CASE WHEN o_orderkey % 6 = 4 THEN {list(PLACES)}[o_orderkey % 3 + 1] ELSE '-' END || '|' || 'Built ' || lower(o_orderpriority) || ' stores and kept them|Tested all' AS e FROM o JOIN c USING (doc_id)),
k AS (SELECT doc_id, home, doc_id % 3 AS k, CAST(doc_id % 10 AS VARCHAR) AS m FROM c),
degrees AS (
  SELECT doc_id, 'degree', 0, 'Bachelor of Technology', 'Computer Science and Engineering', home || ' College', '2010 - 2014', 'CGPA: ' || m || '.5/10' FROM k WHERE k = 0
  UNION ALL SELECT doc_id, 'degree', 0, 'Master of Business Administration', '-', home || ' University', '2010-2014', '-' FROM k WHERE k = 1
  UNION ALL SELECT doc_id, 'degree', 1, 'Higher Secondary (12th)', '-', 'Town School', '2008', '9' || m || '%' FROM k WHERE k = 1
  UNION ALL SELECT doc_id, 'degree', 0, 'Doctor of Philosophy', '-', 'University of ' || home, '2015', '-' FROM k WHERE k = 2
  UNION ALL SELECT doc_id, 'degree', 1, 'Master of Science', 'Information Technology', '-', '-', '-' FROM k WHERE k = 2),
projects AS (SELECT doc_id, 'project', 0, home || ' Store', CASE WHEN k = 1 THEN 'Go,Rust' ELSE '' END, 'Built it for all.', '-', '-' FROM k UNION ALL SELECT doc_id, 'project', 1, 'Second Shop', CASE WHEN k = 1 THEN 'SQL' ELSE '' END, 'Wrote more.', '-', '-' FROM k),
certificates AS (SELECT doc_id, 'certificate', 0, 'AWS Cloud Foundations ' || m, '-', '-', '-', '-' FROM k UNION ALL SELECT doc_id, 'certificate', 1, 'Scrum Master (' || home || ')', '-', '-', '-', '-' FROM k)
SELECT doc_id, kind, CAST(i AS INT) AS i, a, b, c, d, e FROM jobs UNION ALL SELECT * FROM degrees UNION ALL SELECT * FROM projects UNION ALL SELECT * FROM certificates"""
)
def resume_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = P.extract_resumes(resume_texts(spark, sf_dir))
    told = lambda c: F.coalesce(c, F.lit("-"))

    def rows(column, kind, cells):
        """Rows of one kind, numbered, with up to five cells."""
        row = lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), *[told(c).alias(n) for n, c in zip("abcde", [*cells(x), *[F.lit(None).cast("string")] * 5])])
        return F.transform(column, row)

    jobs = rows("experience", "job", lambda x: [x["company"], x["title"], x["start_date"], x["end_date"], F.concat_ws("|", x["employment_type"], told(x["location"]), x["responsibilities"])])
    degrees = rows("education", "degree", lambda x: [x["degree"], x["field_of_study"], x["institution"], x["year"], x["grade"]])
    # duties that tell of something delivered also count as projects, named by their job's title
    named = F.filter("projects", lambda p: ~F.exists("experience", lambda e: e["title"] == p["name"]))
    projects = rows(named, "project", lambda x: [x["name"], F.array_join(x["tools"], ","), x["description"]])
    return found.select("doc_id", F.inline(F.concat(jobs, degrees, projects, rows("certifications", "certificate", lambda x: [x]))))
