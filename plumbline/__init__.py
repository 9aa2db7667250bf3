"""Plumbline: plan-drawing takeoff analytics as PySpark DataFrame plans."""
