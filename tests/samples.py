"""Small files made in memory."""

import io
import zipfile
from email.message import EmailMessage

from dossierflow.plans.built_files import workbook

FILES = "case_id string, source_path string, content binary"


def pdf(marker=b"hello"):
    return b"%PDF-1.4\n" + marker + b"\n%%EOF"


def zipped(entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in entries:
            z.writestr(name, data)
    return out.getvalue()


def mail(subject, body, attachments=()):
    m = EmailMessage()
    m["Subject"] = subject
    m["From"] = "sender@example.com"
    m["To"] = "dest@example.com"
    m.set_content(body)
    for name, data in attachments:
        m.add_attachment(data, maintype="application", subtype="octet-stream", filename=name)
    return m.as_bytes()


def sheet(rows):
    return workbook("Hoja1", rows)


def landed(spark, files, case="c"):
    rows = [(case, name, data) for name, data in files]
    return spark.createDataFrame(rows, FILES)
