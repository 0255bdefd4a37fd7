"""Invented datasheets, one behaviour each."""

PARTS = ["1N7001", "1N7002", "1N7003", "1N7004"]
SERIES = """1N7001 1N7002 1N7003 1N7004
Acme Semiconductors
FEATURES
General purpose. Case: DO-204AL. RoHS compliant.
MAXIMUM RATINGS (TA = 25 C)
PARAMETER SYMBOL 1N7001 1N7002 1N7003 1N7004 UNIT
Maximum repetitive peak reverse voltage VRRM 50 100 200 400 V
Average rectified forward current IF(AV) 1.0 A
Peak forward surge current IFSM 30 30 30 30 A
Working peak voltage VRWM 35 70 V
Operating junction temperature TJ -65 to +150 °C
ELECTRICAL CHARACTERISTICS
Instantaneous forward voltage VF 1.1 V
Forward current 77 A at pulse
"""
RIVAL = """1N7001 1N7002 1N7003 1N7004
Bolt Devices
MAXIMUM RATINGS
PARAMETER 1N7001 1N7002 1N7003 1N7004 UNIT
VRRM 60 100 200 400 V
IF(AV) 1.0 A
"""
PROSE = """LM9317L Three terminal regulator
ABSOLUTE MAXIMUM RATINGS
Input voltage 35 V
FEATURES
Output current up to 100 mA
%s
For higher output current see LM9317 (1.5 A).
""" % ("This device is stable with small capacitors. " * 6)
PLOT = """2N7100 plot
FEATURES
Forward Current (A) 0 0.4 0.2 Forward Voltage (V) 5 10
Typical load line Temperature (°C) 25 50
forward current 9 A
"""
CONTENTS = """Table of contents
Absolute Maximum Ratings ........ 4
Electrical Characteristics ...... 5
%s
Maximum Ratings and Electrical Characteristics
x
Electrical Characteristics
y
""" % ("filler words that are not headings at all " * 3)
MANIFEST = [
    ("acme", 0, "https://acme.example/1n.pdf", "Acme Semiconductors", "MFR_DATASHEET", "1N700x", PARTS),
    ("bolt", 1, "https://bolt.example/1n.pdf", "Bolt Devices", "MFR_DATASHEET", "1N700x", PARTS),
    ("lm", 2, "https://acme.example/lm.pdf", "Acme Semiconductors", "MFR_DATASHEET", "LM9317L", ["LM9317L"]),
    ("lmbig", 3, "https://acme.example/lmb.pdf", "Acme Semiconductors", "MFR_DATASHEET", "LM9317", ["LM9317"]),
    ("plot", 4, "https://acme.example/2n.pdf", "Acme Semiconductors", "MFR_DATASHEET", "2N7100", ["2N7100"]),
]
SKUS = [
    ("S1", "1N7001", "Acme", "diode", "RECTIFIER_DIODE"),
    ("S3", "1N7003", "Acme", "diode", "RECTIFIER_DIODE"),
    ("S4", "1N7001", "Bolt", "diode", "RECTIFIER_DIODE"),
    ("R1", "LM9317L", "Acme", "regulator", "LINEAR_REGULATOR"),
    ("P1", "2N7100", "Acme", "diode", "RECTIFIER_DIODE"),
    ("X1", "NE99999", "Acme", "no document", "RECTIFIER_DIODE"),
]
TEXTS = {"acme": SERIES, "bolt": RIVAL, "lm": PROSE, "lmbig": "LM9317 regulator", "plot": PLOT}


def tables(spark):
    skus = spark.createDataFrame(SKUS, "sku string, mpn string, brand string, description string, product_class string")
    manifest = spark.createDataFrame(MANIFEST, "doc_id string, doc_pos int, url string, publisher string, authority string, title string, covers array<string>")
    pages = [(d, k + 1, t[at : at + 200]) for d, t in TEXTS.items() for k, at in enumerate(range(0, len(t), 200))]
    return skus, manifest, spark.createDataFrame(pages, "doc_id string, page int, text string")
