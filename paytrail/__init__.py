"""Paytrail: payment-message auditing and text analytics as Spark DataFrame plans."""
