"""Daily activity analytics for named places, written as Spark jobs."""
