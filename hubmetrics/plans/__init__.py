"""Plan building blocks shared by the operators and the end-to-end jobs."""
