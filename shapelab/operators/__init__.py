"""shapelab.operators"""
