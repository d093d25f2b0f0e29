"""Command line: verify one message against recorded lookups, make a signing key, sign an attestation.

    python -m vettrail verify --from hr@x.com --company Acme --message-file m.txt --searches recorded/ --registry keys/
    python -m vettrail keygen --domain acme.com --out keys/
    python -m vettrail issue --domain acme.com --key keys/acme.com.private.pem --role Cook --recruiter Ann
"""

from __future__ import annotations

import argparse
import datetime
import json
import os
import pathlib
import sys

from .operators import attestations


def _arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="vettrail", description=__doc__.splitlines()[0])
    commands = parser.add_subparsers(dest="command", required=True)
    v = commands.add_parser("verify", help="check one message; exit status 2 where something serious is found")
    v.add_argument("--from", dest="sender", required=True)
    for name, text in (
        ("company", "the company that the message names"), ("message", "its text"), ("message-file", "a file with its text"), ("role", "the job's title"), ("attestation", "a signed token"),
        ("me", "your own address"), ("searches", "folder of recorded searches"), ("registry", "folder of key documents"), ("pages", "Parquet table of rendered pages"), ("document", "an attached file"),
    ):
        v.add_argument(f"--{name}", help=text)
    v.add_argument("--check-posting", action="store_true", help="look for the role on the careers page")
    v.add_argument("--json", action="store_true")
    k = commands.add_parser("keygen", help="make a signing key and the document to publish")
    k.add_argument("--domain", required=True)
    k.add_argument("--contact")
    k.add_argument("--out", default=".")
    i = commands.add_parser("issue", help="sign an attestation for one message")
    for name in ("domain", "key", "role", "recruiter"):
        i.add_argument(f"--{name}", required=True)
    i.add_argument("--to", help="the recipient's address, of which only a digest is kept")
    i.add_argument("--days", type=int, default=30)
    return parser


def _verify(a: argparse.Namespace) -> int:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from .model import KEYS, METADATA, OUTREACH, PAGES, SPANS
    from .plans import report, verify
    from .sources import pdf, readers

    spark = SparkSession.builder.appName("vettrail").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    table = lambda schema: spark.createDataFrame([], schema)
    searched, results = readers.read_searches(spark, a.searches) if a.searches else readers.nothing_searched(spark)
    keys, published = readers.read_keys(spark, a.registry) if a.registry else (table(KEYS), table("domain string"))
    pages = spark.read.parquet(a.pages) if a.pages else table(PAGES)
    spans, metadata, unread = table(SPANS), table(METADATA), None
    if a.document:
        files = readers.read_uploads(spark, a.document).withColumn("path", F.lit(a.document))
        spans, metadata, read = pdf.read_documents(files)
        unread = read.filter("not available").first()
    message = pathlib.Path(a.message_file).read_text() if a.message_file else a.message or ""
    document = a.document if a.document and unread is None else None
    row = (("1", a.sender.strip(), a.company, message, a.role, a.attestation, a.me, None, a.check_posting, document))
    lookups = verify.Lookups(searched, results, pages, keys, published, spans, metadata)
    out = verify.verify_outreach(spark.createDataFrame([row], OUTREACH), lookups, F.current_timestamp()).cache()
    found = out.first()
    print(json.dumps(json.loads(verify.as_json(out).first().json), indent=2) if a.json else report.reports(out).first().report)
    if unread is not None:
        print(f"The document wasn't checked: {unread.note}", file=sys.stderr)
    return 2 if found.max_rank >= 3 else 0


def main(argv: list[str] | None = None) -> int:
    a = _arguments().parse_args(argv)
    if a.command == "verify":
        return _verify(a)
    if a.command == "keygen":
        seed, out = os.urandom(32), pathlib.Path(a.out)
        out.mkdir(parents=True, exist_ok=True)
        private, public = out / f"{a.domain}.private.pem", out / f"{a.domain}.json"
        private.touch(mode=0o600)
        private.write_text(attestations.private_pem(seed))
        public.write_text(json.dumps(attestations.key_document(seed, a.domain, a.contact), indent=2))
        print(f"Private key, to be kept secret: {private}\nKey document, to be published:  {public}")
        return 0
    now = datetime.datetime.now(datetime.timezone.utc).replace(microsecond=0)
    seed = attestations.seed_of(pathlib.Path(a.key).read_text())
    print(attestations.issue(seed, a.domain.strip().lower(), a.role, a.recruiter, now.isoformat(), (now + datetime.timedelta(days=a.days)).isoformat(), a.to, os.urandom(8).hex()))
    return 0


if __name__ == "__main__":
    sys.exit(main())
