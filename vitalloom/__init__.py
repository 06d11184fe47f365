"""Vitalloom: care-record analytics as Spark jobs over whole tables and streams."""
