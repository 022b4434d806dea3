"""A folder of files, or a table of them, as an object with everything that can be asked of it.

Nothing runs before a result is used; each answer is a table of a row a file.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.operators.convert import convert
from folioscan.operators.results import messages, summary
from folioscan.operators.rules import verify
from folioscan.plans.catalog import Profile
from folioscan.sources.pdf import files_meta, nodes, read_files, unread_files


def save_files(files: DataFrame, folder: str) -> DataFrame:
    """Writes each file (file_id, content) to folder as file_id.pdf; file_id, path, bytes of what was written, when the
    result is used. A file is written under a name of its own and renamed, so a repeated task leaves one whole file. A
    null content isn't written."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        to, base = fs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder)
        to.create_dir(base, recursive=True)
        for b in batches:
            rows = []
            for file_id, content in zip(b.column(0).to_pylist(), b.column(1)):
                if (data := content.as_py()) is None:
                    continue
                own, final = f"{base}/.{uuid.uuid4().hex}", f"{base}/{file_id}.pdf"
                with to.open_output_stream(own) as f:
                    f.write(data)
                to.move(own, final)
                rows.append((file_id, final, len(data)))
            cols = list(zip(*rows)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64())], ["file_id", "path", "bytes"])

    return files.select(F.col("file_id").cast("bigint").alias("file_id"), "content").mapInArrow(write, "file_id bigint, path string, bytes bigint")


class Files:
    """Files by their rows (file_id, content), or those below a folder."""

    def __init__(self, files: DataFrame):
        self.files = files

    @classmethod
    def open(cls, spark: SparkSession, folder: str, pattern: str = "*.pdf") -> Files:
        return cls(read_files(spark, folder, pattern))

    def verify(self, profile: Profile | str = "a_1b") -> tuple[DataFrame, DataFrame]:
        """The issues, and whether each file is valid."""
        return verify(self.files, profile)

    def verify_object_model(self) -> tuple[DataFrame, DataFrame]:
        return self.verify("pdf")

    def is_pdfa(self) -> DataFrame:
        """file_id, valid under the lenient archival profile, whatever a file claims."""
        return verify(self.files, "a_1b", reread=False)[1].select("file_id", "valid")

    def is_pdf(self) -> DataFrame:
        """file_id, valid under the object model alone."""
        return verify(self.files, "pdf", reread=False)[1].select("file_id", "valid")

    def report(self, profile: Profile | str = "a_1b") -> DataFrame:
        """file_id, report: a line a rule with its number of issues; files without issues have no row."""
        return summary(verify(self.files, profile, reread=False)[0])

    def messages(self, profile: Profile | str = "a_1b") -> DataFrame:
        """file_id, message of each issue."""
        return messages(verify(self.files, profile, reread=False)[0])

    def convert(self, profile: Profile | str = "a_1b", **how) -> tuple[Files, DataFrame, DataFrame]:
        """The files mended, whether each is valid now, and the issues that are left."""
        mended, results, left = convert(self.files, profile, **how)
        return Files(mended), results, left

    def convert_object_model(self, **how) -> tuple[Files, DataFrame, DataFrame]:
        return self.convert("pdf", **how)

    def save(self, folder: str) -> DataFrame:
        return save_files(self.files, folder)

    def meta(self) -> DataFrame:
        """Version, pages, claimed conformance, information entries and metadata packet of each file."""
        return files_meta(self.files)

    def claimed_conformance(self) -> DataFrame:
        return self.meta().select("file_id", "part", "conformance")

    def page_counts(self) -> DataFrame:
        return self.meta().select("file_id", "pages")

    def versions(self) -> DataFrame:
        return self.meta().select("file_id", "version")

    def metadata(self) -> DataFrame:
        return self.meta().select("file_id", "info")

    def xmp(self) -> DataFrame:
        return self.meta().select("file_id", "xmp")

    def unread(self) -> DataFrame:
        """file_id, reason of the files whose reading broke off."""
        return unread_files(nodes(self.files))
