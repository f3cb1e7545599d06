"""Records of resume sections in many layouts, headings, and time in proportion to the lines."""

import time

import pytest
from pyspark.sql import functions as F

from ranksmith.operators import headings as H
from ranksmith.operators import records as R

JOBS = [
    ("Cloud Destinations\nSoftware Engineer\nJune 2025 – Present\n- Developed scalable services with Python.\n- Implemented schemas\n  and slow queries.\n- Built workflows.", [("Cloud Destinations", "Software Engineer", "June 2025", "Present", "Full-time", True, 3)]),
    ("TechNova Solutions\nSoftware Engineer\n2023 – Present\n- Maintained services.\n\nCodeBridge Technologies\nJunior Software Engineer\n2022 – 2023\n- Built interfaces.", [("TechNova Solutions", "Software Engineer", "2023", "Present", "Full-time", True, 1), ("CodeBridge Technologies", "Junior Software Engineer", "2022", "2023", "Full-time", False, 1)]),
    ("ABC Corp\nSoftware Engineer Intern\nMay 2024 to July 2024\n- Worked on tools.\n\nXYZ Solutions\nSoftware Engineer\nAug 2024 to Present\n- Leading features.", [("ABC Corp", "Software Engineer Intern", "May 2024", "July 2024", "Internship", False, 1), ("XYZ Solutions", "Software Engineer", "Aug 2024", "Present", "Full-time", True, 1)]),
    ("Role : Freelance Backend Developer\n01/2023 – 12/2023\n- Developed a gateway.", [(None, "Freelance Backend Developer", "01/2023", "12/2023", "Freelance", False, 1)]),
    ("Nimble Wireless Private Ltd\n01/2024 – 06/2024\n- Tested devices.", [("Nimble Wireless Private Ltd", None, "01/2024", "06/2024", "Full-time", False, 1)]),
    ("Technology Solutions Pvt. Ltd.\nIntern\n- Assisted the team.", [("Technology Solutions Pvt. Ltd.", "Intern", None, None, "Internship", False, 1)]),
    ("Data Engineer at Acme Systems | Jan 2020 - Mar 2021\n• Designed stores\nData Analyst, Beta Labs, Apr 2018 - Dec 2019\n• Wrote reports", [("Acme Systems", "Data Engineer", "Jan 2020", "Mar 2021", "Full-time", False, 1), ("Beta Labs", "Data Analyst", "Apr 2018", "Dec 2019", "Full-time", False, 1)]),
    ("Software Engineer\nAcme Systems, Chennai\n2020 - 2021\n- Built it.\nSenior Engineer\nBeta Group\n2021 - now\n- Led it.", [("Acme Systems", "Software Engineer", "2020", "2021", "Full-time", False, 1), ("Beta Group", "Senior Engineer", "2021", "now", "Full-time", True, 1)]),
    ("Project: Something\nPresent\n- Built nothing.", []),
    ("", []),
    (None, []),
]


def test_jobs(spark):
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(JOBS)], "k int, t string")
    got = {r.k: [(j.company, j.title, j.start_date, j.end_date, j.employment_type, j.is_current, len(j.responsibilities)) for j in r.e] for r in df.select("k", R.experience_records(F.col("t")).alias("e")).collect()}
    assert got == {k: want for k, (_, want) in enumerate(JOBS)}


def test_wrapped_duties_and_place():
    job = R.experience("Acme Systems, Pune\nLead Engineer\n2 years\n- Designed the store\n  that holds all.\n- Ran it.")[0]
    assert job["responsibilities"] == ["Designed the store that holds all.", "Ran it."] and job["location"] == "Pune" and job["duration"] == "2 years"


@pytest.mark.parametrize(
    "text, want",
    [
        ("B.Tech in Computer Science & Engineering\nABC College of Engineering\n2018 - 2022\nCGPA: 8.5/10\nHSC\nXYZ Higher School\n2018\n91%", [("Bachelor of Technology", "Computer Science and Engineering", "ABC College of Engineering", "2018 - 2022", "CGPA: 8.5/10"), ("Higher Secondary (12th)", None, "XYZ Higher School", "2018", "91%")]),
        ("State University 2016-2020 B.E. ECE Town School 2016 12th 88.5%", [("Bachelor of Engineering", "Electronics and Communication Engineering", "State University", "2016-2020", None), ("Higher Secondary (12th)", None, "Town School", "2016", "88.5%")]),
        ("MBA, University of Delhi, 2019", [("Master of Business Administration", None, "University of Delhi", "2019", None)]),
        ("PhD\nMaster of Science in Information Technology", [("Doctor of Philosophy", None, None, None, None), ("Master of Science", "Information Technology", None, None, None)]),
        ("it was made by me to be sold", []),
    ],
)
def test_education(text, want):
    assert [tuple(r.values()) for r in R.education(text)] == want


def test_fields_that_no_table_knows_stay():
    of = lambda text: [(r["degree"], r["field_of_study"], r["institution"]) for r in R.education(text)]
    assert of("B.Tech in ANODIZED") == [("Bachelor of Technology", "ANODIZED", None)]
    assert of("Diploma in Arts and Crafts, Town School 2010\nMBA in 2012") == [("Diploma", "Arts and Crafts", "Town School"), ("Master of Business Administration", None, None)]
    assert of("B.Sc in Computer Science") == [("Bachelor of Science", "Computer Science and Engineering", None)]
    assert of("M.Tech in State University") == [("Master of Technology", None, "State University")]


PROJECTS = [
    ("Project Alpha | Python, FastAPI • Developed REST endpoints with async tasks. • Reduced latency by 45% using Redis. Project Beta | React, TypeScript • Built dashboards. • Implemented a UI. Project Gamma | Docker, Kubernetes, AWS • Deployed services.", [("Project Alpha", ["Python", "FastAPI"]), ("Project Beta", ["React", "TypeScript"]), ("Project Gamma", ["Docker", "Kubernetes", "AWS"])]),
    ("Article Scraper Tool 2026 Built a tool using Selenium. Validated search. Shopping Collaboration App 2025 Developed a web platform.", [("Article Scraper Tool", []), ("Shopping Collaboration App", [])]),
    ("Distributed Ledger Platform | Go, gRPC, PostgreSQL • Implemented consensus. Analytics Dashboard System | Vue.js, Node.js • Visualized metrics.", [("Distributed Ledger Platform", ["Go", "gRPC", "PostgreSQL"]), ("Analytics Dashboard System", ["Vue.js", "Node.js"])]),
    ("Project: Smart City Traffic\n• Built a service.\n• Integrated detection.\nProject: Cloud Storage Gateway\n• Implemented a store.", [("Smart City Traffic", []), ("Cloud Storage Gateway", [])]),
    ("Project: Cloud Infrastructure Monitoring & Automation\n- Linux monitoring with CloudWatch: Configured alarms.\n- Database backup system: Wrote scripts.\n- API Gateway configuration: Enforced limits.", [("Cloud Infrastructure Monitoring & Automation", [])]),
    ("DevOps Automation Suite | AWS, Docker, Kubernetes\n- Task 1: Implemented code.\n- Task 2: Configured charts.", [("DevOps Automation Suite", ["AWS", "Docker", "Kubernetes"])]),
    ("Shop Front\nDeveloped pages.\nTools: Rust, Go\n\nStock List\nBuilt lists.", [("Shop Front", ["Rust", "Go"]), ("Stock List", [])]),
    ("Ledger Tools used: Rust, Go\n- Wrote it.\n2024 FASHIONBOOK-(FRONTEND) Developed a page.", [("Ledger", ["Rust", "Go"]), ("FASHIONBOOK-(FRONTEND)", [])]),
    ("a small thing that was done over many long years", [("a small thing that was", [])]),
    ("", []),
]


@pytest.mark.parametrize("text, want", PROJECTS)
def test_projects(text, want):
    assert [(p["name"], p["tools"]) for p in R.projects(text)] == want


def test_project_text_keeps_its_signs():
    p = R.projects("Data Pipeline Engine | Python, PySpark • Processed 100,000+ daily events; filtered nulls/duplicates. • Maintained 99.9% uptime (24/7 SLAs) with error-recovery & auto-retries.")[0]
    assert all(x in p["description"] for x in ("100,000+", "99.9%", "error-recovery & auto-retries"))


def test_certificates(spark):
    text = "AWS Academy Cloud-\nFoundations\n• Geographical Information\nSystem(IIRS)\nAzure Data Fund amentals | Python Basics\nBadges\nInternship at home\nOracle SQL - Training\nScrum Master, 3"
    want = ["AWS Academy Cloud Foundations", "Geographical Information System (IIRS)", "Azure Data Fundamentals", "Python Basics", "Oracle SQL", "Scrum Master"]
    df = spark.createDataFrame([(text,), (None,)], "t string")
    assert [r.c for r in df.select(R.certificate_names(F.col("t"), ("fundamentals", "data")).alias("c")).collect()] == [want, []]


def test_headings():
    found = H.Lexicon().section
    assert [found(x) for x in ("EXPERIENCE:", "Work Experiance", "Intership", "## Projects & Certifications", "Educaiton", "My technical skills", "the education of a young person here", "a b c d e f skills", "Skils")] == ["experience", "experience", "experience", "projects", "education", "skills", None, None, None]


def test_lines_carry_their_section(spark):
    long = "Ann EDUCATION B.Tech " + "x " * 600 + "Work  Experience: Acme"
    df = spark.createDataFrame([(0, "Ann\nSkills\nPython\nSkills\n\nExperiance\nAcme"), (1, long), (2, ""), (3, None), (4, "no heading")], "k int, t string")
    got = {r.k: [(x.section, x.line[:6]) for x in r.s] for r in df.select("k", H.section_lines(F.col("t")).alias("s")).collect()}
    assert got == {0: [("header", "Ann"), ("skills", "Python"), ("skills", "Skills"), ("experience", "Acme")], 1: [("header", "Ann"), ("education", "B.Tech"), ("experience", "Acme")], 2: [], 3: [], 4: [("header", "no hea")]}


@pytest.mark.parametrize(
    "make, run",
    [
        (lambda n: "\n".join("Skills" if i % 9 else f"Line {i} of a text" for i in range(n)), H.Lexicon().lines),
        (lambda n: "\n".join(f"Acme Systems\nData Engineer\n20{i % 90 + 10} - now\n- Built {i}" for i in range(n // 4)), R.experience),
        (lambda n: "\n".join("MBA\nTown College 2010" for _ in range(n // 8)), R.education),
        (lambda n: "\n".join(f"Shop {i} | Go, Rust\n- Built it. Then more." for i in range(n // 2)), R.projects),
        (lambda n: "\n".join("cloud of" for _ in range(n // 16)), lambda t: R.certificates(t, frozenset())),
    ],
)
def test_time_is_in_proportion_to_lines(make, run):
    """Eight times the lines take less than 24 times as long."""
    took = []
    for n in (1000, 8000):
        text, best = make(n), 1e9
        for _ in range(3):
            start = time.perf_counter()
            run(text)
            best = min(best, time.perf_counter() - start)
        took.append(best)
    assert took[1] < 24 * took[0] + 0.05


def test_contacts(spark):
    from ranksmith.operators import extraction as E

    texts = ["Phone: +91 93440 81155\n+1 555 123 4567", "Mobile 1234567890\n+1 (555) 123-4567", "\n" * 13 + "9876501234", "call 98765-01234", "xx 9999999999", "Ann@Mail.comhttps://x.y", "none", None]
    got = [(r.p, r.e) for r in spark.createDataFrame([(t,) for t in texts], "t string").select(E.phone(F.col("t")).alias("p"), E.email(F.col("t")).alias("e")).collect()]
    assert got == [("+919344081155", None), ("+15551234567", None), (None, None), ("9876501234", None), (None, None), (None, "ann@mail.com"), (None, None), (None, None)]


def test_skill_lines_are_joined_and_mined(spark):
    from ranksmith.operators import jobs as J

    text = "- Strong knowledge of Python, Go,\n  Rust and\n  SQL\n- Build services using FastAPI, Docker and Kubernetes.\n- Experience with data\nstores is a plus\n- Shop - developed pages with React\n- Write well with others"
    got = spark.createDataFrame([(text,)], "t string").select(J.skill_terms(F.col("t")).alias("s")).first().s
    assert got.skills == ["Python", "Go", "Rust and SQL", "FastAPI", "Docker", "Kubernetes", "data stores", "React"]
    assert got.duties == ["Build services using FastAPI, Docker and Kubernetes.", "Shop - developed pages with React", "Write well with others"]


def test_vendor_gaps(spark):
    from ranksmith.operators import vendor as V

    rows = spark.createDataFrame([(1, None), (2, "no json"), (3, '{"candidateName": {"raw": "Ann Bee"}, "workExperience": [{}, {"workExperienceJobTitle": "Intern"}], "phoneNumber": [{"rawText": "12"}], "email": []}')], "id int, payload string")
    local = spark.createDataFrame([(1, "Loc", ["a"]), (3, "Loc", [])], "id int, name string, skills array<string>")
    got = {r.id: (r.name, r.phone, r.skills, [(j.title, j.employment_type) for j in r.experience], r.filled_fields) for r in V.filled(V.map_resume(rows), local, "id").collect()}
    assert got == {1: ("Loc", None, ["a"], [], ["name", "skills"]), 2: (None, None, [], [], []), 3: ("Ann Bee", "12", [], [("Intern", "Internship")], [])}
