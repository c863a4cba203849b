"""hexaloc: six-part resource identifiers, selectors and matching as Spark columns."""
