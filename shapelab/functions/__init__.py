"""shapelab.functions"""
