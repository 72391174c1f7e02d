"""shapelab.streaming"""
