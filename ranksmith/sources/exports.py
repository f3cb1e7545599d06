"""Exports of one project's candidates, and outboxes for what leaves by mail or network.

CSV and JSON are written by the executors.  Workbook and page exports hold one project's rows, which their
reader opens as a whole: they take at most ``MAX_ROWS`` and say so when there are more.
"""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Header of the candidate export, and the three sheets of the workbook.
HEADER = ["Rank", "Candidate Name", "Email", "Final Score", "Recommendation", "Confidence", "Skills Score", "Experience Score", "Matched Skills", "Missing Skills", "Status"]
SHEETS = ("Candidate Rankings", "Skills Analysis", "Campaign Summary")
SUMMARY = ("total_candidates", "average_score", "highest_score", "lowest_score", "average_confidence", "knocked_out_count")
COLUMNS = ["rank_position", "candidate", "email", "final_score", "recommendation", "confidence", "skills_score", "experience_score", "matched_skills", "missing_skills"]
MAX_ROWS = 100_000


def flat_rows(rows: DataFrame) -> DataFrame:
    """The export's columns under its header: lists joined by comma and blank, no mail as empty, knock-outs as a status."""
    kinds = dict(rows.dtypes)
    cells = [F.array_join(c, ", ") if kinds[c].startswith("array") else F.coalesce(c, F.lit("")) if c == "email" else F.col(c) for c in COLUMNS]
    status = F.when(F.col("is_knocked_out"), "KNOCKED_OUT").otherwise("ELIGIBLE")
    return rows.select(*[c.alias(h) for c, h in zip([*cells, status], HEADER, strict=True)])


def write_csv(rows: DataFrame, path: str, most: int = MAX_ROWS) -> None:
    """Header and rows by rank; the first column's name carries the byte order mark that spreadsheet programs look for.

    Up to ``most`` rows, which is what one file is opened for, make one file.  More are dealt by ranges of rank to files that are in
    order by their names, each with its header and its part of the rows; a file without rows is not written.
    """
    flat = flat_rows(rows).withColumnRenamed(HEADER[0], "\ufeff" + HEADER[0])
    first = F.col("\ufeff" + HEADER[0])
    small = rows.limit(most + 1).count() <= most
    spread = flat.coalesce(1) if small else flat.repartitionByRange(first)
    spread.sortWithinPartitions(first).write.mode("overwrite").csv(path, header=True)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def _bounded(rows: DataFrame, most: int) -> list:
    got = rows.limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"more than {most} rows; export CSV or JSON instead")
    return got


def workbook(sheets: dict[str, DataFrame], most: int = MAX_ROWS, scaled: tuple[str, int] | None = None) -> bytes:
    """An .xlsx file with one sheet for each table, the header row frozen and filterable.

    ``scaled`` names a sheet and the place of a column whose cells are coloured from red at the least to green at the greatest.
    """
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        names = list(sheets)
        part = '<Override PartName="/xl/worksheets/sheet{}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>'
        z.writestr(
            "[Content_Types].xml",
            '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
            + "".join(part.format(i + 1) for i in range(len(names)))
            + "</Types>",
        )
        rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        z.writestr("_rels/.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i + 1}" Type="{rel}/worksheet" Target="worksheets/sheet{i + 1}.xml"/>' for i in range(len(names))) + "</Relationships>")
        z.writestr("xl/workbook.xml", f'<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})[:31]}" sheetId="{i + 1}" r:id="r{i + 1}"/>' for i, n in enumerate(names)) + "</sheets></workbook>")
        for i, n in enumerate(names):
            rows = [sheets[n].columns, *map(list, _bounded(sheets[n], most))]
            z.writestr(f"xl/worksheets/sheet{i + 1}.xml", _sheet(rows, scaled[1] if scaled and scaled[0] == n else None))
    return out.getvalue()


def _column(i: int) -> str:
    name = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        name = chr(65 + r) + name
    return name


def report_workbook(rows: DataFrame, skills: DataFrame, summary: DataFrame) -> bytes:
    """Candidates by rank with a colour scale of final scores, skills (Type, Skill, Frequency, Percentage), and the campaign's figures.

    ``summary`` has one row with the columns of ``SUMMARY``; figures that are null count as 0.
    """
    figures = F.array(*[F.struct(F.lit(c.replace("_", " ").title()).alias("Figure"), F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias("Value")) for c in SUMMARY])
    named = dict(zip(SHEETS, (flat_rows(rows).orderBy(HEADER[0]), skills, summary.select(F.inline(figures))), strict=True))
    return workbook(named, scaled=(SHEETS[0], HEADER.index("Final Score")))


def skills_sheet(candidates: DataFrame, matched: str = "matched_skills", missing: str = "missing_skills", most: int = 10) -> DataFrame:
    """(Type, Skill, Frequency, Percentage): the commonest matched and missing skills, each candidate counting once for each skill."""
    total = candidates.agg(F.count("*").alias("total"))
    parts = []
    for kind, column in (("Matched", matched), ("Missing", missing)):
        found = candidates.select(F.explode(F.array_distinct(column)).alias("Skill")).groupBy("Skill").agg(F.count("*").alias("Frequency"))
        parts.append(found.orderBy(F.desc("Frequency"), "Skill").limit(most).select(F.lit(kind).alias("Type"), "Skill", "Frequency"))
    share = F.round(F.col("Frequency") * 100 / F.col("total"), 2)
    # the total is one row
    return parts[0].unionByName(parts[1]).join(F.broadcast(total)).select("Type", "Skill", "Frequency", share.alias("Percentage")).orderBy("Type", F.desc("Frequency"), "Skill")


def _sheet(rows: list[list], scaled: int | None = None) -> str:
    def cell(v, ref: str) -> str:
        if isinstance(v, bool) or v is None or not isinstance(v, (int, float)):
            text = "" if v is None else ", ".join(map(str, v)) if isinstance(v, list) else str(v)
            return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'
        return f'<c r="{ref}"><v>{v}</v></c>'

    body = "".join(f'<row r="{r + 1}">' + "".join(cell(v, f"{_column(c)}{r + 1}") for c, v in enumerate(row)) + "</row>" for r, row in enumerate(rows))
    scale = ""
    if scaled is not None and len(rows) > 1:
        c = _column(scaled)
        scale = f'<conditionalFormatting sqref="{c}2:{c}{len(rows)}"><cfRule type="colorScale" priority="1"><colorScale><cfvo type="min"/><cfvo type="max"/><color rgb="FFF8696B"/><color rgb="FF63BE7B"/></colorScale></cfRule></conditionalFormatting>'
    last = f"{_column(max(0, len(rows[0]) - 1))}{len(rows)}"
    return f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews><sheetData>{body}</sheetData><autoFilter ref="A1:{last}"/>{scale}</worksheet>'


def one_page_pdf(title: str, summary: list[str], rows: DataFrame, order, most: int = 10) -> bytes:
    """A page with the title, summary lines and the first ``most`` candidates."""
    lines = [title, "", *summary, ""] + [" | ".join("" if v is None else str(v) for v in r) for r in rows.orderBy(*order).limit(most).collect()]
    plain = lambda s: s.encode("latin-1", "replace").decode("latin-1").replace("\\", r"\\").replace("(", r"\(").replace(")", r"\)")
    stream = ("BT /F1 10 Tf 40 800 Td 14 TL " + " ".join(f"({plain(x)}) Tj T*" for x in lines) + " ET").encode("latin-1")
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>", b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 595 842] /Contents 4 0 R /Resources << /Font << /F1 5 0 R >> >> >>", b"<< /Length %d >>\nstream\n%b\nendstream" % (len(stream), stream), b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"]
    out, places = b"%PDF-1.4\n", []
    for i, o in enumerate(objects):
        places.append(len(out))
        out += b"%d 0 obj\n%b\nendobj\n" % (i + 1, o)
    table = b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    return out + table + b"trailer << /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF" % (len(objects) + 1, len(out))


def _to_file(content: bytes, path: str) -> None:
    with open(path, "wb") as f:
        f.write(content)


def export(rows: DataFrame, kind: str, path: str, title: str = "", skills: DataFrame | None = None, summary: DataFrame | None = None) -> None:
    """One project's candidates as csv, json, xlsx or pdf; the last two are single files on the caller's machine and need ``summary``."""
    if kind == "csv":
        write_csv(rows, path)
    elif kind == "json":
        write_json(rows, path)
    elif kind == "xlsx":
        _to_file(report_workbook(rows, skills_sheet(rows) if skills is None else skills, summary), path)
    elif kind == "pdf":
        figures = summary.select(*SUMMARY).first().asDict()
        lines = [f"{k.replace('_', ' ').title()}: {v or 0}" for k, v in figures.items()]
        _to_file(one_page_pdf(f"{title} - Candidate Report", lines, rows.select("rank_position", "candidate", "final_score", "recommendation"), ["rank_position"]), path)
    else:
        raise ValueError(f"no export to {kind}")


def outbox(rows: DataFrame, key: str, kind: str) -> DataFrame:
    """Messages to send, with an idempotency key made from kind and payload; sending is left to another program."""
    payload = F.to_json(F.struct(*rows.columns))
    return rows.select(F.col(key).cast("string").alias("recipient"), F.lit(kind).alias("kind"), payload.alias("payload"), F.sha2(F.concat_ws("|", F.lit(kind), payload), 256).alias("idempotency_key"))
