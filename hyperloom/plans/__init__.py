"""Named query plans: one Spark query and one SQL twin each."""
