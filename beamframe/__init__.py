"""beamframe: train/pulse analytics for pulsed-beam detectors, as DataFrame -> DataFrame operators."""
