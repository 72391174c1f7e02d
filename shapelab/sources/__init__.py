"""shapelab.sources"""
