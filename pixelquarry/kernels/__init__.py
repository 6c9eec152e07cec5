"""Array kernels: functions of whole frames (height x width x 4 float64, unassociated, 0 to 1), run inside one mapInPandas."""
