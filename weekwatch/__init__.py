"""weekwatch: weekly surveillance analytics as Spark DataFrame operators."""
