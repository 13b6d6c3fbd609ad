"""Readers, and the views that give plain tables the shapes the operators expect."""
