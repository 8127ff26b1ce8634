"""What files begin with, against results by hand."""

import pytest

from soundtally.sources import headers

FULL = "Time (Date hh:mm:ss.ms),LEQ dB-A,Lmax dB-A,L10 dB-A,L90 dB-A"
CASES = [
    ("sentry", [], "unlikely_valid", "File appears to be empty.", "", 0),
    ("sentry", ["", " \t"], "unlikely_valid", "No header row detected in file head.", "", 0),
    ("sentry", ["Export", "", "  " + FULL + " "], "likely_valid", "Detected 5 standard Noise Sentry header columns.", FULL, 5),
    # a header below the first 20 lines doesn't count
    ("sentry", ["Export"] + [""] * 19 + [FULL], "needs_review", "Header does not match typical Noise Sentry structure.", "Export", 0),
    ("sentry", ["x", "TIME;leq"], "needs_review", "Only a subset of expected Noise Sentry columns were detected.", "TIME;leq", 2),
    ("svan", ["", "  "], "unlikely_valid", "No readable lines found in file header.", "", 0),
    # 'date' and 'time' are in one cell
    ("svan", ["Site", "", "Date & time,LAeq,LAFmax"], "likely_valid", "Detected 4 typical SVAN column markers.", "Site\nDate & time,LAeq,LAFmax", 4),
    ("svan", ["a", "b", "SvanPC++", "c"], "needs_review", "Only a subset of SVAN markers detected in header.", "a\nb", 0),
    ("svan", ["a", "b", "c", "d", "e", "SvanPC++"], "needs_review", "Header did not resemble typical SVAN exports.", "a\nb", 0),
    # the first line with a word is the header, even if a later one has more
    ("svan", ["Update 4", "Date,Time,LAeq,LAFmax"], "needs_review", "Header did not resemble typical SVAN exports.", "Update 4\nDate,Time,LAeq,LAFmax", 1),
    ("nti", ["# Hardware Configuration", "Serial Number: 3", "# RTA Log Results LZeq", "", "x", "y"], "likely_valid", "Found 3 NTi section markers in header.", "# Hardware Configuration\nSerial Number: 3\n# RTA Log Results LZeq\nx", 3),
    ("nti", ["Serial number: 3"], "needs_review", "Detected limited NTi markers; double-check file contents.", "Serial number: 3", 1),
    ("nti", ["x"] * 40 + ["# RTA Results"], "needs_review", "Header did not include recognizable NTi markers.", "x\nx\nx\nx", 0),
    ("generic", ["", "Timestamp,level", "x"], "likely_valid", "Header contains datetime-related tokens.", "Timestamp,level", 2),
    ("generic", ["level", "Timestamp"], "needs_review", "Header does not clearly indicate datetime columns.", "level", 0),
    ("generic", [" "], "needs_review", "Header does not clearly indicate datetime columns.", "", 0),
    ("generic", ["Date" + "x" * 300], "likely_valid", "Header contains datetime-related tokens.", "Date" + "x" * 196, 1),
    ("audio", ["RIFF"], "unknown", "", "", 0),
    (None, ["x"], "unknown", "", "", 0),
]


@pytest.fixture(scope="module")
def got(spark):
    files = spark.createDataFrame([(str(i), c[0], i) for i, c in enumerate(CASES)], "path string, reader string, status_was int")
    lines = spark.createDataFrame([(str(i), n, line) for i, c in enumerate(CASES) for n, line in enumerate(c[1])], "path string, line_no long, line string")
    return {int(r["path"]): r for r in headers.hints(files, lines).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_hint(got, i):
    assert (got[i]["status"], got[i]["reason"], got[i]["excerpt"], got[i]["matches"]) == CASES[i][2:]
