"""Millrace: tabular preparation, simple learners, trees and graph traversal as lazy Spark plans."""
