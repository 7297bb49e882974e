"""Every query the package answers, by operator family."""

from . import artifact_control, calibration, decisions, inputs, libraries, planes, runs, spectra  # noqa: F401
