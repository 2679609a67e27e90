"""Fixed values. Results depend on these numbers and names, so they are stated, not derived."""

# Optical-density vectors (RGB) of the stains: calibrated set, used by default.
CALIBRATED = {
    "hematoxylin": (0.786, 0.593, 0.174),
    "dab": (0.215, 0.422, 0.881),
    "residual": (0.547, -0.799, 0.249),
}

# The seven stain-vector sets whose votes make a soft label.
VECTOR_SETS = {
    "calibrated": ((0.786, 0.593, 0.174), (0.215, 0.422, 0.881), (0.547, -0.799, 0.249)),
    "ruifrok_default": ((0.650, 0.704, 0.286), (0.268, 0.570, 0.776), (0.711, 0.424, 0.562)),
    "interp_25": ((0.752, 0.621, 0.202), (0.228, 0.459, 0.855), (0.588, -0.493, 0.327)),
    "interp_50": ((0.718, 0.649, 0.230), (0.242, 0.496, 0.829), (0.629, -0.188, 0.406)),
    "interp_75": ((0.684, 0.676, 0.258), (0.255, 0.533, 0.802), (0.670, 0.118, 0.484)),
    "perturb_warm": ((0.770, 0.610, 0.190), (0.280, 0.440, 0.850), (0.530, -0.700, 0.280)),
    "perturb_cool": ((0.800, 0.575, 0.160), (0.190, 0.400, 0.900), (0.560, -0.850, 0.220)),
}

# Grading and eligibility cut-points.
GRADE_CUTS = (0.10, 0.20, 0.35)
POSITIVE_GRADE = 2
ELIGIBLE_PCT = 75.0
COMPOSITE_CUTS = (0.05, 0.15, 0.30)  # negative / weak / strong intensity
THICK_PX = 8.0
CIRCUMFERENTIAL = 0.5
DAB_POSITIVE = 0.10

# Calibration range of each grade cut-point, and the least sample size.
CALIBRATION_RANGES = ((0.05, 0.15), (0.10, 0.25), (0.20, 0.40))
CALIBRATION_MIN = 50

# The named morphometric filters (name, min area, min solidity, max aspect).
MORPHOMETRIC_FILTERS = (
    ("No filter", 0.0, 0.0, None),
    ("Mild (area>=15)", 15.0, 0.0, None),
    ("Moderate (area>=25, sol>=0.85)", 25.0, 0.85, 3.0),
    ("Standard (area>=25, sol>=0.9, asp<=2.5)", 25.0, 0.9, 2.5),
    ("Strict (area>=35, sol>=0.92, asp<=2.0)", 35.0, 0.92, 2.0),
    ("Debate (area>=80, sol>=0.9, asp<=2.0)", 80.0, 0.9, 2.0),
)

# Names written into results.
FLIPS = ("BOTH_ELIGIBLE", "BOTH_NOT_ELIGIBLE", "GAINED", "LOST", "MISSING_DATA")
DAB_LEVELS = (("Negative", 0.05), ("Low", 0.15), ("Moderate", 0.30), ("High", None))
PATIENT = "Patient_Tissue"
CONTROL = "iCAP_Control"
DISCLAIMER = "Research use only. Thresholds are not calibrated."

# Tile geometry in pixels at the read level.
TILE_PX = 512
TILE_PAD = 80

# Oriented bar filter bank.
BAR_SIZE, BAR_SIGMA_LONG, BAR_SIGMA_SHORT, BAR_ORIENTATIONS = 25, 5.0, 1.0, 8

# Cell filter limits.
MIN_NUCLEUS, MAX_NUCLEUS, MIN_CELL, MAX_RATIO, MIN_COVERAGE = 20, 5000, 50, 5.0, 0.3
